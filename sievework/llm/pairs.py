"""Broken question and answer pairs: which answers are defective, and how.

Evidence comes from the whole column first. Answers of one question are sorted
by text and each is compared with its neighbour: one that its neighbour begins
with is a shortened version. Lengths that far more answers have than the
lengths around them are limits at which answers were cut. Sentences that stand
in answers to many different questions are boilerplate, and an answer of
nothing else tells nothing about its question.

The end of the text is cut (a broken construct), closed (an end mark) or open
(neither). A cut end is truncated. An open one is if it runs on as text does,
or if the answer is shortened or at a limit, which decides short ends. A closed
one is only if the answer is shortened and at a limit at once. Boilerplate only
is a refusal, as are answers that decline by the listed phrases. Rules on the
pair decide echo and language.

Defined results: a null answer is empty, whatever the question; without a
question (null, blank or no such case) echo and language are not decided; at
most one defect per result, in the order empty, echo, refusal, truncated,
language; a row delivered twice counts once.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.session import cut

# --- Fixed values: words and phrases by which answers are recognised ---------

#: Whole answers that stand for no answer.
PLACEHOLDERS = frozenset(
    ["null", "none", "nil", "nan", "n/a", "na", "empty", "no content", "no answer", "undefined", "tbd", "todo"]
)

#: Sentences that decline or say that no answer can be given.
REFUSALS = re.compile(
    r"""
    \b(?:don['’]?t|do\ not|doesn['’]t)\ (?:know|have\ (?:enough|sufficient)|contain\ enough|allow)
    | \b(?:can(?:['’]?t|not|\ not)|won['’]t|will\ not|unable\ to|not\ able\ to|not\ be\ able\ to|may\ not|must\ not)
      \ (?:be\ able\ to\ )?(?:give|help|assist|answer|discuss|comment|speak|provide|respond|offer|share|say)
    | \bmust\ decline | \bhave\ to\ decline | \b(?:i|we)\ decline | \bnothing\ i\ could\ speak
    | \bwould\ rather\ not | \bprefer\ not\ to | \bno\ answer\ (?:can|could|is)
    | \bfalls?\ outside\ (?:of\ )?what | \boutside\ (?:of\ )?(?:my|the)\ scope
    | \bnot\ contain\ enough | \bnot\ enough\ information | \binsufficient\ information
    | \bnothing\ in\ the\ (?:knowledge|documents|sources|provided) | \bno\ (?:relevant|matching)\ (?:information|content|documents)
    | \bno\ basis\ in | \blets\ me\ say | \bnot\ something\ i\ (?:can|may) | \bsomething\ i\ may\ not
    | \bnicht\ helfen | \bkeine\ (?:auskunft|antwort|angabe|aussage)n?\b | \bablehnen\b | \bwei(?:ß|ss)\ ich\ (?:leider\ )?nicht | \bich\ wei(?:ß|ss)\ (?:es\ )?nicht
    | \breichen\ .{0,40}\bnicht\ aus | \bkann\ ich\ (?:leider\ )?nicht | \bkann\ .{0,40}nicht\ beantwort | \bnicht\ beantworten
    | \bne\ permett(?:ent|rait)\ pas | \bne\ peux\ pas | \bne\ pas\ me\ prononcer | \bje\ l['’]ignore | \bje\ ne\ sais\ pas
    | \bne\ suis\ pas\ en\ mesure | \brefuser\ de\ répondre | \baucune?\ (?:réponse|information)
    | \bno\ lo\ sé | \bno\ puedo | \bno\ bastan\ para | \bdeclinar | \bno\ es\ posible\ responder | \bno\ hay\ (?:suficiente\ )?información
    | \bprefiero\ no | \bdesconozco
    | 不足以(?:作答|回答) | 给不出答案 | 不便(?:讨论|回答|透露) | 无法(?:回答|作答|提供|协助|给出) | 不能(?:协助|回答|提供|讨论) | 不清楚 | 不知道
    | 没有相关(?:内容|信息|资料) | 拒绝回答
    """,
    re.I | re.X,
)

#: Courtesies, hints and openings that answer nothing.
FILLERS = re.compile(
    r"""^(?:
    hello | hi | hey | good\ question | thank(?:s|\ you)\b.* | thanks\ for\ asking.* | is\ there\ anything\ else.*
    | please\ (?:upload|rephrase|try|provide|contact|consult|add)\b.* | try\ (?:rephrasing|again|asking)\b.* | (?:maybe|perhaps)\ another\ source.*
    | several\ passages\ mention.* | i\ (?:have\ )?(?:looked|searched|read)\b.* | regarding\b.* | sorry.* | apologies.* | unfortunately.* | i\ am\ sorry.*
    | hallo | guten\ tag | gute\ frage | danke\b.* | vielen\ dank.* | bitte\ (?:die|laden|stellen|formulieren|wenden)\b.* | weitere\ unterlagen.* | ich\ habe\ alles.*
    | es\ tut\ mir\ leid.* | leider.*
    | bonjour | bonne\ question | merci\b.* | essayez\b.* | il\ faudrait\b.* | j['’]ai\ (?:relu|lu|parcouru)\b.* | (?:je\ suis\ )?désolée?.* | veuillez\b.*
    | hola | buena\ pregunta | gracias\b.* | pruebe\b.* | intente\b.* | harían\ falta.* | he\ (?:leído|revisado|buscado)\b.* | lo\ siento.* | por\ favor\b.*
    | 您好 | 你好 | 感谢.* | 谢谢.* | 请.* | 也许.* | 我查看.* | 抱歉.* | 很遗憾.* | 好问题
    )$""",
    re.I | re.X,
)

#: error_message texts that report a cut answer.
CUT_MESSAGE = re.compile(
    r"finish[_ ]?reason\W*(?:length|max_tokens)|(?:output|token|length)[ _]limit|limit of \d+ tokens|max(?:imum)?[_ ]tokens"
    r"|cut (?:off|by|after|short)|truncat|(?:stream|response|connection) (?:closed|ended|aborted|interrupted) (?:early|prematurely|before)"
    r"|incomplete (?:response|answer|stream)",
    re.I,
)

#: Requests for an answer in a certain language.
ASKED_LANGUAGE = {
    "en": r"auf\ englisch|en\ inglés|en\ anglais|in\ english|用英[语文]|请用英|以英[语文]",
    "de": r"in\ german|auf\ deutsch|en\ alemán|en\ allemand|用德[语文]|以德[语文]",
    "fr": r"in\ french|auf\ französisch|en\ francés|en\ français|用法[语文]|以法[语文]",
    "es": r"in\ spanish|auf\ spanisch|en\ español|en\ espagnol|用西班牙[语文]|以西班牙[语文]",
    "zh": r"in\ chinese|auf\ chinesisch|en\ chino|en\ chinois|用中文|用汉语|以中文",
}
_REQUEST = re.compile(
    r"(?:answer|reply|respond|antwort\w*|répond\w*|respond\w*|contest\w*|回答|作答|答复|用|以)", re.I
)
_ASKED = {k: re.compile(v, re.I | re.X) for k, v in ASKED_LANGUAGE.items()}

#: Frequent short words by language.
STOPWORDS = {
    "en": "the a an of to and is are was in on at for by with each our only when while once until what which that so who how why does did should if not from before after under over its it this these those as be can cannot here you no any".split(),
    "de": "der die das den dem des ein eine einen einem einer und ist sind war in im am an auf für mit von zu nach bei nur wenn weil wann warum was wer wie welche dass nicht oder aber ohne unter vor hinter ob es sich zur zum als auch binnen".split(),
    "fr": "le la les l un une des du de et est sont était dans en sur au aux pour par avec quand que qui quoi pourquoi comment si ne pas ou mais sans sous avant après derrière durant pendant se ce cette puis donc chaque notre".split(),
    "es": "el la los las un una unos unas de del y es son era en por para con cuando que qué quién cómo cuándo si no o pero sin bajo antes tras después durante se lo al así cada nuestro su como".split(),
}
_WORD = re.compile(r"[^\W\d_]+")
_HAN = re.compile("[㐀-䶿一-鿿豈-﫿]")
_LANGUAGE_OF: dict[str, list[str]] = {}
for _l, _ws in STOPWORDS.items():
    for _w in _ws:
        _LANGUAGE_OF.setdefault(_w, []).append(_l)
_LETTERS = {"de": frozenset("äöüß"), "fr": frozenset("àâçèêëîïôùûœé"), "es": frozenset("ñáíóú")}
# ------------------------------------------------------------------------------

_INVISIBLE = regex.compile(r"[\p{C}--\n\t]+", regex.V1)
_NOT_ALNUM = re.compile(r"[\W_]+")
_CITATION = re.compile(r"\[\^?\d+(?:\s*[,;-]\s*\d+)*\]|【\d+】")
_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_INLINE = re.compile(r"`[^`\n]*`")
_QUOTED = re.compile(r"“[^”]*”|«[^»]*»|„[^“”]*[“”]|「[^」]*」|『[^』]*』|\"[^\"\n]*\"")
_LIST_MARK = re.compile(r"\n[ \t]*(?:\(?\d{1,3}[.)、]|[*•-])\Z")
_SENTENCE = re.compile(r"[^.!?。！？;；:：\n]+[.!?。！？;；:：]*")


def visible(text: str | None) -> str:
    """The text without invisible characters and outer blanks."""
    if text is None:
        return ""
    return (text if text.isprintable() else _INVISIBLE.sub("", text)).strip()


def letters_only(text: str) -> str:
    """Letters and digits without case, width, spacing and punctuation."""
    folded = text.casefold() if text.isascii() else unicodedata.normalize("NFKC", text).casefold()
    return _NOT_ALNUM.sub("", folded)


def is_empty(answer: str | None) -> bool:
    """No content of its own: blank, invisible, placeholder, bare punctuation or citation marks."""
    body = _CITATION.sub(" ", visible(answer))
    core = letters_only(body)
    return not core or re.sub(r"[^\w/ ]+", "", body).strip().casefold() in PLACEHOLDERS


def is_echo(question: str, answer: str) -> bool:
    """Nothing but the question, however often, quoted or labelled."""
    asked = letters_only(visible(question))
    if not asked:
        return False
    said = letters_only(_CITATION.sub(" ", visible(answer)))
    rest = said.replace(asked, "")
    return rest != said and rest in ("", "q", "question", "frage", "pregunta", "问题", "问", "提问", "a", "answer", "you asked", "youasked")


def is_refusal(answer: str) -> bool:
    """Some sentence declines and no other sentence says anything."""
    body = _CITATION.sub(" ", visible(answer))
    if "```" in body:
        return False
    declined = False
    for found in _SENTENCE.finditer(_QUOTED.sub(" ", body)):
        s = found.group().strip(" \t\n.!?。！？;；:：,，\"'“”")
        if not letters_only(s):
            continue
        if REFUSALS.search(s):
            declined = True
        elif not all(FILLERS.match(p.strip()) for p in re.split(r"[，,]", s)[:1]):
            return False
    return declined


def is_unfinished(answer: str) -> bool:
    """The text stops before a sentence, list item, bracket, quotation or code block ends."""
    body = visible(answer)
    if body.count("```") % 2:
        return True
    if body.endswith("```"):
        return False
    tail = _CITATION.sub("", body).rstrip()
    if re.search(r"\[\^?\d*$", tail) or _LIST_MARK.search(tail):
        return True
    if not tail:
        return False
    last = tail[-1]
    if last in "`" and tail.count("`") % 2 == 0:
        return False
    if last in ":：,，;；、—–-(（[【“„«‘/&+=_":
        return True
    if last in ".!?。！？…":
        return False
    if last in ")）]】”»’\"'」』*|>}":
        pairs = {")": "(", "）": "（", "]": "[", "】": "【", "”": "“", "»": "«", "」": "「", "』": "『", "}": "{"}
        return last in pairs and tail.count(last) > tail.count(pairs[last]) + 1
    # No end mark: values and short labels are complete, running text is not.
    if re.search(r"[.!?。！？](?:\s|$|[^\d\s])", tail) or "\n" in tail:
        return True
    words = _WORD.findall(tail)
    short = len(words) <= 3 and not _HAN.search(tail) and len(tail) <= 40
    return not (short and (re.search(r"\d", tail) or len(words) <= 2)) and not (_HAN.search(tail) and len(tail) <= 6)


def is_open(answer: str) -> bool:
    """The end of the text doesn't tell whether it is complete: no end mark and no closed code block."""
    body = _CITATION.sub("", visible(answer)).rstrip(" \t\n*_|>\"'”’»」』)）]】}")
    return not visible(answer).endswith("```") and body[-1:] not in tuple(".!?。！？…")


def language(text: str) -> str | None:
    """en, de, fr, es or zh, None where the words don't tell."""
    plain = _QUOTED.sub(" ", _INLINE.sub(" ", _FENCE.sub(" ", visible(text))))
    han = len(_HAN.findall(plain))
    words = [w for w in _WORD.findall(plain.casefold()) if not _HAN.search(w)]
    if han >= 4 and han * 2 > sum(map(len, words)):
        return "zh"
    score = dict.fromkeys(STOPWORDS, 0.0)
    for w in words:
        for l in _LANGUAGE_OF.get(w, ()):
            score[l] += 1.0 / len(_LANGUAGE_OF[w])
        if not w.isascii():
            for l, marks in _LETTERS.items():
                if not marks.isdisjoint(w):
                    score[l] += 0.5
    best, second = sorted(score.values(), reverse=True)[:2]
    if best < 1.0 or best < 1.3 * second:
        return None
    return max(score, key=score.get)


def wanted_language(question: str) -> str | None:
    """The language the question asks for, anywhere in it and first of all, else its own.

    A request is the name of a language and a word like "answer" within 60 characters.
    """
    q = visible(question)
    named = sorted((m.start(), m.end(), l) for l, pattern in _ASKED.items() for m in pattern.finditer(q))
    for start, end, l in named:
        if _REQUEST.search(q[max(0, end - 60) : start + 60]):
            return l
    return language(q)


def is_other_language(question: str, answer: str) -> bool:
    said = language(answer)
    if said is None:
        return False
    asked = wanted_language(question)
    return asked is not None and asked != said


def sentence_keys(answer: str | None) -> list[int]:
    """64-bit keys of the answer's sentences that hold letters or digits, outside quotations; each once."""
    from xxhash import xxh3_64_intdigest

    body = _QUOTED.sub(" ", _CITATION.sub(" ", visible(answer)))
    words = dict.fromkeys(filter(None, (letters_only(s.group()) for s in _SENTENCE.finditer(body))))
    # a lone value or label is no boilerplate, however many share it
    if not any(len(w) >= (10 if w.isascii() else 5) for w in words):
        return []
    return [xxh3_64_intdigest(w.encode("utf-8", "replace")) - (1 << 63) for w in words]


def defect_of(
    question: str | None, answer: str | None, message: str | None, shortened: bool, at_limit: bool, boilerplate: bool = False
) -> str | None:
    """The defect of one pair, or None."""
    if is_empty(answer):
        return "empty"
    if question and is_echo(question, answer):
        return "echo"
    if boilerplate or is_refusal(answer):
        return "refusal"
    if is_unfinished(answer) or (message and CUT_MESSAGE.search(message)):
        return "truncated"
    if (shortened and at_limit) or ((shortened or at_limit) and is_open(answer)):
        return "truncated"
    if question and is_other_language(question, answer):
        return "language"
    return None


def shortened_answers(df: DataFrame, case: str, answer: str, head: int = 16) -> DataFrame:
    """(case, answer) of the distinct answers that their neighbour in text order begins with.

    Only answers with the same first `head` characters can be such neighbours,
    so those are sorted together: a question with a third of all answers is
    spread over its openings. Equal answers are one row beforehand.
    """
    distinct = df.where(F.length(answer) >= head).select(case, answer).distinct()
    by = Window.partitionBy(case, F.substring(answer, 1, head)).orderBy(answer)
    following = distinct.withColumn("_next", F.lead(answer).over(by))
    return following.where(F.col("_next").startswith(F.col(answer))).select(case, answer)


def length_limits(df: DataFrame, answer: str, factor: float = 8.0, least: int = 30, reach: int = 5) -> DataFrame:
    """(length) of answers that `factor` times as many have as have the lengths around it on average."""
    counts = df.where(F.col(answer).isNotNull()).groupBy(F.length(answer).alias("length")).agg(F.count("*").alias("n"))
    near = counts.select(
        F.explode(F.sequence(F.col("length") - reach, F.col("length") + reach)).alias("length"), F.col("n").alias("m")
    ).groupBy("length").agg(F.sum("m").alias("around"))
    joined = counts.join(near, "length")
    usual = (F.col("around") - F.col("n")) / (2.0 * reach)
    return joined.where((F.col("n") >= least) & (F.col("n") > factor * usual) & (F.col("length") >= 100)).select("length")


def boilerplate_answers(df: DataFrame, key: str, case: str, answer: str, many: int = 10, share: float = 0.001) -> DataFrame:
    """(key) of the answers all of whose sentences stand in answers to many different questions.

    Many are at least `many` and at least `share` of all questions. Counted
    over all answers: distinct (sentence, question) first, so a sentence in a
    third of all answers is summed before the shuffle. Answers with any other
    sentence, and lone values, are none.
    """

    @F.pandas_udf("array<bigint>")
    def keys(answers: pd.Series) -> pd.Series:
        return pd.Series([sentence_keys(a) for a in answers], dtype=object)

    said = cut(df.where(F.col(answer).isNotNull()).select(key, case, keys(F.col(answer)).alias("_k")).where(F.size("_k") > 0))
    each = said.select(key, case, F.size("_k").alias("_n"), F.explode("_k").alias("_s"))
    asked = said.select(case).distinct().agg(F.count("*")).scalar()
    shared = each.select("_s", case).distinct().groupBy("_s").agg(F.count("*").alias("_m"))
    shared = shared.where((F.col("_m") >= many) & (F.col("_m") >= share * asked))
    found = each.join(shared.select("_s"), "_s").groupBy(key, "_n").agg(F.count("*").alias("_m"))
    return found.where("_m = _n").select(key)


def defective_pairs(results: DataFrame, cases: DataFrame) -> DataFrame:
    """(result_id, defect) of every defective result.

    results: id, case_id, answer, error_message, each id once. cases: id,
    question. Rows without a case stay (their question is null).
    """
    asked = results.select("id", "case_id", "answer", "error_message").join(
        cases.select(F.col("id").alias("case_id"), "question"), "case_id", "left"
    )
    short = shortened_answers(results, "case_id", "answer").withColumn("shortened", F.lit(True))
    limits = length_limits(results, "answer").withColumn("at_limit", F.lit(True))
    plain = boilerplate_answers(results, "id", "case_id", "answer").withColumn("boilerplate", F.lit(True))
    marked = asked.join(short, ["case_id", "answer"], "left").join(limits, F.length("answer") == F.col("length"), "left")
    marked = marked.join(plain, "id", "left")

    @F.pandas_udf("string")
    def defect(q: pd.Series, a: pd.Series, e: pd.Series, s: pd.Series, n: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([defect_of(*row) for row in zip(q, a, e, s, n, b)], dtype=object)

    flags = [F.coalesce(c, F.lit(False)) for c in ("shortened", "at_limit", "boilerplate")]
    found = defect("question", "answer", "error_message", *flags)
    return marked.select(F.col("id").alias("result_id"), found.alias("defect")).where("defect is not null")
