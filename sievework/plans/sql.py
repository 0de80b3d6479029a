"""Building blocks of the SQL twins (DuckDB): the same definitions written a second time."""

BLANK = r"[ \t\n\x0b\f\r]+"
HEADING = (
    r"^(#{1,6}[ \t\n\x0b\f\r]+.+|第[一二三四五六七八九十百千万0-9]{1,12}[章节篇部卷].*"
    r"|[0-9]{1,3}([.．、]|\))[ \t\n\x0b\f\r]*.+|[一二三四五六七八九十百千万]{1,6}[、.．）)][ \t\n\x0b\f\r]*.+"
    r"|（[一二三四五六七八九十百千万]{1,6}）[ \t\n\x0b\f\r]*.+)$"
)


def trimmed(x: str) -> str:
    return rf"regexp_replace({x}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


def cleaned(x: str) -> str:
    lines = f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    return trimmed(rf"regexp_replace(regexp_replace({lines}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


def squashed(x: str) -> str:
    return f"regexp_replace(lower({x}), '{BLANK}', '', 'g')"


def heading(x: str) -> str:
    return f"regexp_matches({x}, '{HEADING}')"


def without(x: str, words: list[str]) -> str:
    for w in words:
        x = f"replace({x}, '{w}', '')"
    return x


def terms(question: str, shortest: int, stop: list[str]) -> str:
    """List of terms of a question: tokens or n-grams, then the phrase."""
    words = "[" + ",".join(f"'{w}'" for w in stop) + "]"
    grams = " || ".join(
        f"(case when length(t) >= {n} then list_transform(range(1, length(t) - {n - 2}), lambda i: substr(t, i, {n})) else []::varchar[] end)"
        for n in range(shortest, 4)
    )
    token = f"case when regexp_matches(t, '[一-龥]') then list_filter({grams}, lambda g: not list_contains({words}, g)) else [t] end"
    tokens = f"list_filter(regexp_split_to_array({squashed(question)}, '[^a-z0-9一-龥]+'), lambda t: length(t) >= {shortest} and not list_contains({words}, t))"
    phrase = without(squashed(question), stop)
    every = f"flatten(list_transform({tokens}, lambda t: {token})) || (case when length({phrase}) > 0 then [{phrase}] else []::varchar[] end)"
    return f"list_filter({every}, lambda x, i: list_position({every}, x) = i)"


CHUNKS = "chunks as (select id, any_value(document_id) as document_id, any_value(content) as content, any_value(chunk_index) as chunk_index, any_value(content_hash) as content_hash, any_value(vector_id) as vector_id from document_chunk group by id)"
DOCS = """docs as (select * from document qualify row_number() over (
  partition by id order by update_time desc nulls last, file_size desc nulls last, status desc nulls last) = 1)"""
RESULTS = "results as (select distinct on (id) * from eval_case_result)"
CASES = "cases as (select distinct on (id) * from eval_case)"
RUNS = "runs as (select distinct on (id) * from eval_run)"
