"""Markup residue: which markup languages a text really uses, and its clean text.

Markup is stripped line by line; headings become `# ...` lines, list items
`- ...`, code stays in fences or backticks, formulas between dollar signs.
Then the line-block distribution decides what is content: text lengths without
those of links, navigation and footers are summed over a sliding window of
filled lines, a surge at a line of some length opens a block of content, the
next dive closes it. Between surge and dive everything stays. Outside, lines of nothing
but several links, of navigation or a footer, and copyright lines go, as do
leftover marks; other short lines are titles as often as not and stay.

Defined results: null texts give null and no kinds, empty ones stay empty;
plain texts come out as they are (line ends and outer blanks apart).
Comparisons, type parameters, placeholders, paths, prices, citation marks and
identifiers are not markup. Constructs count when escaped as entities and when
the text's edge cuts them.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("html", "markdown", "wiki", "latex")

# --- Fixed values: names that the four languages define ------------------------

HTML_TAGS = (
    "a abbr address article aside audio b blockquote body br button caption center cite code col colgroup dd del "
    "details dfn div dl dt em embed fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr "
    "html i iframe img input ins kbd label legend li link main mark meta nav noscript object ol option p param pre "
    "q s samp script section select small source span strike strong style sub summary sup svg table tbody td "
    "textarea tfoot th thead time title tr tt u ul var video wbr"
).split()
WIKI_WORDS = "NOTOC TOC FORCETOC NOEDITSECTION NEWSECTIONLINK INDEX NOINDEX NOGALLERY HIDDENCAT".split()
LATEX_COMMANDS = (
    "alpha author bar begin beta bibitem bibliography bigskip binom boldsymbol caption cdot cdots centering chapter "
    "cite citep citet cos date delta displaystyle documentclass dots emph end ensuremath epsilon eqref eta exists "
    "exp footnote forall frac gamma geq ge hat hbox hfill hline href hspace in includegraphics infty input int "
    "item itshape kappa label lambda langle large ldots left leftarrow leq le lim ln log maketitle mathbb mathbf "
    "mathcal mathrm max mbox min mu nabla neq newcommand newline newpage noindent nu omega overline paragraph "
    "partial phi pi pm prime prod psi quad qquad rangle ref rho right rightarrow section sigma sin small sqrt "
    "subparagraph subsection subset subsubsection sum tableofcontents tau text textbf textit textrm textsc textsf "
    "texttt theta tilde times title to underline url usepackage vec verb vspace widehat xi zeta"
).split()
MATH_ENVIRONMENTS = "equation align gather multline eqnarray displaymath math".split()
# --------------------------------------------------------------------------------

_TAGS = "|".join(sorted(HTML_TAGS, key=len, reverse=True))
_TAG = re.compile(rf"<(/?)({_TAGS})((?:\s+[^<>]*)?)(/?)>", re.I)
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<!doctype[^<>]*>|\A[^<>]*?-->", re.S | re.I)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#x[0-9a-f]{1,6}|[a-z][a-z0-9]{1,30});", re.I)
_TAG_LEFT = re.compile(r"\A(?:[^<>\n]*?(?<![\w-])[\w-]++\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*')|[\w-]*=?\"[^\"<>\n]*\"|[^\s<>]*\")\s*/?>")
_TAG_LEFT_NAME = re.compile(rf"\A/?(?:{_TAGS})>", re.I)
_TAG_RIGHT = re.compile(r"<(/?)([a-z][a-z0-9]{0,11})((?:\s+[^<>]*)?)\Z|<(/|!-{0,2})\Z", re.I)
_PATH = re.compile(r"(?<![A-Za-z])[A-Za-z]:\\[^\s]*|\\\\[\w.]+\\[^\s]*")

_FENCE = re.compile(r"^ {0,3}(```+|~~~+)")
_MARKDOWN = re.compile(
    r"""(?mx)
      ^\ {0,3}\#{1,6}\ +\S
    | ^\ {0,3}(?:```|~~~)
    | (?<!`)`[^`\n]+`(?!`)
    | (?<![\w*\\])\*\*(?=[^\s*])[^*\n]+?(?<=[^\s*])\*\*(?![\w*])
    | (?<![\w*\\/])\*{1,3}(?=[^\s*])[^*\n]+?(?<=[^\s*\\])\*{1,3}(?![\w*])
    | (?<![\w_\\/.])_{1,3}(?=[^\s_])(?!(?:NOTOC|TOC|[a-z]+)__(?=\W|\Z))[^_\n]+?(?<=[^\s_])_{1,3}(?![\w(])
    | (?<![\w_])__(?=[^\s_])[^_\n]*\s[^_\n]*(?<=[^\s_])__(?!\w)
    | ~~(?=\S)[^~\n]+?(?<=\S)~~
    | !?\[[^\[\]\n]*\]\((?:[^()\s]+|<[^<>\n]*>)(?:\s+"[^"\n]*")?\)
    | \[[^\[\]\n]*[^\W\d][^\[\]\n]*\]\[[^\[\]\n]*\]
    | ^\ {0,3}\[[^\[\]\n]+\]:\ *\S
    | \[\^[^\[\]\s]+\]
    | ^\ *\|?\ *:?-{2,}:?\ *(?:\|\ *:?-{2,}:?\ *)+\|?\ *$
    | ^\ {0,3}[-+*]\ +\[[ xX]\]\ +\S
    | ^\ {0,3}>\ ?\S
    | <(?:https?://|mailto:)[^<>\s]+>
    """
)
_SETEXT = re.compile(r"(?m)^(?=\S)(?![|>#{}!=-]).*\S[ \t]*\n(?:={3,}|-{3,})[ \t]*$")
_MD_ROW = re.compile(r"(?m)^\|(?![-}+])[^\n]*\|[^\n]*\|[ \t]*$")
_MD_BULLET = re.compile(r"(?m)^ {0,3}[-+*] +\S")
_MD_EDGE = re.compile(r"\A[^\[\]\n]*\]\([^()\s]+\)|!?\[[^\[\]\n]*\]\([^()\s]*\Z|(?m:^ {0,3}#{1,6}\Z)")

_WIKI = re.compile(
    r"""(?mx)
      \[\[[^\[\]\n]*[^\W\d_][^\[\]\n]*\]\]
    | \{\{[^{}\n]*[^\W\d_][^{}\n]*\}\}
    | (?<!')''(?:''')?(?=[^\s'])[^\n]*?(?<=[^\s'])''(?!')
    | (?<!')'''(?=[^\s'])[^\n]*?(?<=[^\s'])'''(?!')
    | ^(={2,6})\ *[^\s=](?:.*[^\s=])?\ *\1\ *$
    | ^\{\|
    | ^\|\}\ *$
    | ^\|-\ *$
    | \[(?:https?|ftp)://[^\s\[\]]+(?:\ [^\[\]\n]*)?\]
    | ^\#REDIRECT\b
    | ^::+\ *\S
    | </?(?:nowiki|ref|gallery)\b[^<>]*>
    """
)
_WIKI_MAGIC = re.compile(rf"__(?:{'|'.join(WIKI_WORDS)})__")
_WIKI_EDGE = re.compile(r"\A[^\[\]\n]+\]\]|\[\[[^\[\]\n\d]*\Z|\A[^{}\n]+\}\}|\{\{[^{}\n]*\Z")

_COMMANDS = "|".join(sorted(LATEX_COMMANDS, key=len, reverse=True))
_LATEX = re.compile(
    rf"""(?mx)
      (?<![\\\w])\\(?:{_COMMANDS})\*?(?![A-Za-z])
    | \\[\[(](?=[^\n]*)
    | \$\$[^$]+\$\$
    | \$(?=\S)[^$\n]*(?:\\[A-Za-z]+|\^|_\{{)[^$\n]*\$
    | \$[A-Za-z](?:_\w|\^\w)?\$
    | &[^\n]*\\\\\ *$
    | \d\\%
    """
)
_LATEX_EDGE = re.compile(r"\A[a-z]{0,12}\*?\}(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})?\n|\\(?:begin|end|sub|text|foot|sect|ite?)[a-z]*\*?\{?[a-z]*\Z")


def _has_html(text: str) -> bool:
    if "<" in text:
        for m in _TAG.finditer(text):
            name, before = m.group(2), text[m.start() - 1] if m.start() else ""
            parameter = not m.group(1) and not m.group(3) and not m.group(4) and len(name) == 1 and name.isupper() and before.isascii() and before.isalnum()
            if not parameter:
                return True
        m = _TAG_RIGHT.search(text)
        if m:
            name = (m.group(2) or "").lower()
            if m.group(4) or (m.group(3) and name in HTML_TAGS) or any(t.startswith(name) for t in HTML_TAGS):
                return True
    if ("<!" in text or "-->" in text) and _COMMENT.search(text):
        return True
    if ">" in text and (_TAG_LEFT.search(text) or _TAG_LEFT_NAME.search(text)):
        return True
    if "&" in text:
        return any(m.group()[1] == "#" or html.unescape(m.group()) != m.group() for m in _ENTITY.finditer(text))
    return False


def kinds_of(text: str | None) -> list[str]:
    """The markup languages that the text uses."""
    if not text or not _ANY.search(text):
        return []
    kinds = []
    if _has_html(text):
        kinds.append("html")
    # what is escaped as entities counts for its own language; paths look like commands
    plain = _PATH.sub(" ", html.unescape(text) if "&" in text else text)
    without_code = re.sub(r"(?s)(?:^|(?<=\n)) {0,3}(```|~~~).*?(?:\n {0,3}\1|\Z)", "", plain)
    without_code = re.sub(r"`[^`\n]*`", "", without_code)
    wiki = bool(_WIKI.search(without_code) or _WIKI_MAGIC.search(without_code) or _WIKI_EDGE.search(without_code))
    body = _WIKI_MAGIC.sub(" ", plain) if wiki else plain
    latex = bool(_LATEX.search(without_code) or _LATEX_EDGE.search(without_code))
    if (
        _MARKDOWN.search(body)
        or _MD_EDGE.search(body)
        or (_SETEXT.search(body))
        or (_MD_ROW.search(body) and not re.search(r"(?m)^\{\||^\|[-}]\s*$", body))
        or (not wiki and not latex and _MD_BULLET.search(body))
    ):
        kinds.append("markdown")
    if wiki:
        kinds.append("wiki")
    if latex:
        kinds.append("latex")
    return kinds


_STRUCTURE = re.compile(r"```|#|- |\$|\d{1,3}[.)] ")
_COPYRIGHT = re.compile(r"(?:©|\(c\)|copyright\b)", re.I)
#: Private characters around links and around navigation and footers, until the lines are chosen.
_LINK, _LINK_END, _MENU, _MENU_END = "\ue000", "\ue001", "\ue002", "\ue003"
_LINKED = re.compile(f"{_LINK}[^{_LINK_END}]*{_LINK_END}?")
_MARKS = re.compile(f"[{_LINK}-{_MENU_END}]")

#: A text without any of these has no markup.
_ANY = re.compile(r"[<>&`*_#|=~$\[\]{}\\]|''|(?m:^\s*[-+:]|-{3}|-->)")

_BLOCK_TAGS = "p|div|br|tr|table|ul|ol|dl|hr|section|article|figure|blockquote|header|footer|nav|aside|main|caption|figcaption|h[1-6]|thead|tbody|form"


def _strip_html(text: str) -> str:
    text = _COMMENT.sub("", text)
    text = re.sub(r"(?is)<(script|style)\b.*?(?:</\1>|\Z)", "", text)
    if not _MARKS.search(text):  # texts that use these characters keep them, and their menus
        text = re.sub(r"(?is)<(nav|footer)\b[^<>]*>(.*?)(?:</\1>|\Z)", rf"\n{_MENU}\2{_MENU_END}\n", text)
        text = re.sub(r"(?is)<a\b[^<>]*>(.*?)</a>", rf"{_LINK}\1{_LINK_END}", text)
    text = re.sub(r"(?is)<pre\b[^<>]*>\s*(?:<code\b[^<>]*>)?(.*?)(?:</code>)?\s*</pre>", r"\n```\n\1\n```\n", text)
    text = re.sub(r"(?i)<h([1-6])(?:\s[^<>]*)?>", lambda m: "\n" + "#" * int(m[1]) + " ", text)
    text = re.sub(r"(?i)<li(?:\s[^<>]*)?>", "\n- ", text)
    text = re.sub(r"(?i)</?code(?:\s[^<>]*)?>", "`", text)
    text = re.sub(r"(?i)</t[dh]>\s*<t[dh](?:\s[^<>]*)?>", " | ", text)
    text = re.sub(r"(?i)<img\b[^<>]*?\balt\s*=\s*[\"']([^\"']*)[\"'][^<>]*>", r"\1", text)
    text = re.sub(rf"(?i)</?(?:{_BLOCK_TAGS})(?:\s[^<>]*)?/?>", "\n", text)
    text = _TAG.sub("", text)
    text = _TAG_LEFT.sub("", text)
    m = _TAG_RIGHT.search(text)
    if m and any(t.startswith((m.group(2) or "").lower()) for t in HTML_TAGS):
        text = text[: m.start()]
    return text


def _strip_wiki(text: str) -> str:
    text = _WIKI_MAGIC.sub("", text)
    text = re.sub(r"(?m)^[*#]+ +", "- ", text)
    text = re.sub(r"(?m)^(={2,6}) *([^\n]*?) *\1 *$", lambda m: "#" * len(m[1]) + " " + m[2], text)
    text = re.sub(r"\[\[(?:Category|Kategorie|Catégorie|Categoría|分类):[^\[\]\n]*\]\]", "", text, flags=re.I)
    text = re.sub(r"(?m)^#REDIRECT:?\s*", "", text, flags=re.I)
    text = re.sub(r"\[\[(?:[^\[\]|\n]*\|)*([^\[\]|\n]*)\]\]", r"\1", text)
    text = re.sub(r"\[(?:https?|ftp)://[^\s\[\]]+ ?([^\[\]\n]*)\]", r"\1", text)
    text = re.sub(r"\{\{[^{}]*\}\}", "", text)
    text = re.sub(r"'{2,5}", "", text)
    text = re.sub(r"(?m)^\{\|[^\n]*$|^\|[-}][^\n]*$", "", text)
    text = re.sub(r"(?m)^[|!]\+? ?(.*)$", lambda m: re.sub(r"\s*(?:\|\||!!)\s*", " | ", m[1]), text)
    return re.sub(r"(?m)^:+ *", "", text)


def _strip_latex(text: str) -> str:
    text = re.sub(r"(?m)(?<!\\)%[^\n]*$", "", text)
    maths = "|".join(MATH_ENVIRONMENTS)
    text = re.sub(rf"(?s)\\begin\{{({maths})\*?\}}\s*(.*?)\s*\\end\{{\1\*?\}}", r"$ \2 $", text)
    text = re.sub(r"(?s)\\\[\s*(.*?)\s*\\\]|\\\(\s*(.*?)\s*\\\)", lambda m: f"$ {m[1] or m[2]} $", text)
    text = re.sub(r"(?s)\\begin\{(verbatim|lstlisting)\}(.*?)\\end\{\1\}", r"```\2```", text)
    level = {"chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}
    text = re.sub(
        r"\\(chapter|section|subsection|subsubsection|paragraph)\*?\{([^{}]*)\}", lambda m: f"\n{'#' * level[m[1]]} {m[2]}\n", text
    )
    pieces = re.split(r"(\$\$?[^$]+\$\$?)", text)  # formulas stay as written
    for i in range(0, len(pieces), 2):
        p = re.sub(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]\n]*\])?(?:\{[^{}]*\})?", "\n", pieces[i])
        p = re.sub(r"\\item\b *", "- ", p)
        p = re.sub(r"~?\\(?:cite[pt]?|ref|eqref|label|bibliography|input|usepackage|documentclass)(?:\[[^\]]*\])?\{[^{}]*\}", "", p)
        p = re.sub(r"\\footnote\{([^{}]*)\}", r" (\1)", p)
        p = re.sub(r"\\(?:textbf|textit|emph|textrm|textsc|textsf|underline|text|mbox|title|author|caption)\*?\{([^{}]*)\}", r"\1", p)
        p = re.sub(r"\\texttt\{([^{}]*)\}", r"`\1`", p)
        p = re.sub(r"\\\\ *$", "", p, flags=re.M)
        p = re.sub(r"\\([%&#_{}])", r"\1", p)
        p = re.sub(r"(?<=\S) & (?=\S)", " | ", p)
        pieces[i] = re.sub(r"\\(?:hline|centering|maketitle|noindent|newpage|bigskip|tableofcontents)\b", "", p)
    return "".join(pieces)


def _strip_markdown(text: str) -> str:
    out, code = [], None
    lines = text.split("\n")
    for n, line in enumerate(lines):
        fence = _FENCE.match(line)
        if fence:
            code = None if code and line.strip().startswith(code) else code or fence.group(1)
            out.append("```")
            continue
        if code:
            out.append(line)
            continue
        if re.fullmatch(r"\s*(?:={3,}|-{3,})\s*", line) and out and out[-1].strip() and n and lines[n - 1].strip():
            if not out[-1].startswith("#"):
                out[-1] = "# " + out[-1].strip()
            continue
        if re.fullmatch(r" *\|?(?: *:?-{2,}:? *\|)+(?: *:?-{2,}:?)? *", line) or re.fullmatch(r" {0,3}(?:-{3,}|\*{3,}|_{3,}) *", line):
            continue
        if re.match(r" {0,3}\[[^\[\]^\n]+\]: *\S+$", line):
            continue
        line = re.sub(r"^ {0,3}(#{1,6}) +(.*?)(?: +#+)? *$", r"\1 \2", line)
        line = re.sub(r"^( {0,3})[-+*] +(?:\[[ xX]\] +)?", r"\1- ", line)
        line = re.sub(r"^ {0,3}> ?", "", line)
        if line.startswith("|") and line.rstrip().endswith("|"):
            line = line.strip().strip("|").strip()
        parts = re.split(r"(`[^`\n]+`|\$[^$\n]+\$)", line)
        for i in range(0, len(parts), 2):
            p = re.sub(r"!?\[([^\[\]\n]*)\]\([^()\s]*(?:\s+\"[^\"]*\")?\)", r"\1", parts[i])
            p = re.sub(r"\[([^\[\]\n]*[^\W\d][^\[\]\n]*)\]\[[^\[\]\n]*\]", r"\1", p)
            p = re.sub(r"\[\^[^\[\]\s]+\]:? ?", "", p)
            p = re.sub(r"(?<![\w*])\*{1,3}(?=[^\s*])([^*\n]+?)(?<=[^\s*])\*{1,3}(?![\w*])", r"\1", p)
            p = re.sub(r"(?<![\w_])_{1,3}(?=[^\s_])([^_\n]+?)(?<=[^\s_])_{1,3}(?![\w_])", r"\1", p)
            p = re.sub(r"~~(?=\S)([^~\n]+?)~~", r"\1", p)
            parts[i] = re.sub(r"<((?:https?://|mailto:)[^<>\s]+)>", r"\1", p)
        out.append("".join(parts))
    return "\n".join(out)


def content_blocks(lengths: list[int], window: int = 3, surge: int = 40) -> list[bool]:
    """Which lines lie between a surge and the next dive of the window sums.

    The sum of a window counts for its first line. A surge is a window above
    `surge` whose first line has more than half of that, a dive is a window of
    at most half of it.
    """
    n = len(lengths)
    prefix = [0]
    for x in lengths:
        prefix.append(prefix[-1] + x)
    keep, inside = [False] * n, False
    for i in range(n):
        block = prefix[min(n, i + window)] - prefix[i]
        if not inside and block > surge and lengths[i] * 2 > surge:
            inside = True
        elif inside and block * 2 <= surge:
            inside = False
        keep[i] = inside
    return keep


def clean(text: str | None, kinds: list[str] | None = None) -> str | None:
    """Clean text that keeps headings, lists, code and formulas recognisable."""
    if text is None:
        return None
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    kinds = kinds_of(text) if kinds is None else kinds
    if not kinds:
        return text.strip()
    raw = text
    own = _MARKS.search(text) is not None
    if "html" in kinds:
        if "&" in text:
            text = html.unescape(text).replace("\xa0", " ")
        text = _strip_html(text)
    if "latex" in kinds:
        text = _strip_latex(text)
    if "wiki" in kinds:
        text = _strip_wiki(text)
    if "markdown" in kinds:
        text = _strip_markdown(text)
    lines, texts, menu = [], [], False
    for line in text.split("\n"):
        menu = not own and (menu or _MENU in line)
        bare = re.sub(r"[ \t]{2,}", " ", line if own else _MARKS.sub("", line)).strip()
        rest = "" if menu else re.sub(r"[ \t]{2,}", " ", line if own else _MARKS.sub("", _LINKED.sub("", line))).strip()
        lines.append(bare)
        texts.append((len(rest), 0 if own else line.count(_LINK), bool(bare) and not any(map(str.isalnum, rest)), menu))
        menu = menu and line.rfind(_MENU_END) <= line.rfind(_MENU)
    filled = [i for i, line in enumerate(lines) if line]
    inside = [False] * len(lines)
    for i, content in zip(filled, content_blocks([texts[i][0] for i in filled])):
        inside[i] = content
    plain = set(l.strip() for l in raw.split("\n"))
    out, code, blank = [], False, True
    for i, (line, content) in enumerate(zip(lines, inside)):
        if line.startswith("```"):
            code = not code
        _, links, linked, in_menu = texts[i]
        beside = any(0 <= j < len(texts) and texts[j][1] and texts[j][2] for j in (i - 1, i + 1))
        menu_line = in_menu or (linked and (links > 1 or (links == 1 and beside)))
        if code or content:
            kept = True
        elif line not in plain and (menu_line or _COPYRIGHT.match(line)):
            kept = False
        else:
            kept = line in plain or _STRUCTURE.match(line) or any(map(str.isalnum, line))
        if line and kept:
            out.append(line)
            blank = False
        elif not line and not blank:
            out.append("")
            blank = True
    return "\n".join(out).strip()


def clean_text(text: Column) -> Column:
    """struct(kinds array<string>, text string) of each text, in Arrow batches."""

    @F.pandas_udf("kinds array<string>, text string")
    def run(texts: pd.Series) -> pd.DataFrame:
        kinds = [kinds_of(t) for t in texts]
        return pd.DataFrame({"kinds": kinds, "text": [clean(t, k) for t, k in zip(texts, kinds)]})

    return run(text)
