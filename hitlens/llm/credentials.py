"""Secret scan with multipart credential linking, in DataFrame functions alone.

Strong patterns (the base kinds) are reported wherever they match. Weak candidates, an identifier, a secret under a
vague name, a bare key-like run, the login inside an address or an endpoint, are reported only where a complementary part lies in the same scope:
the block of lines up to a blank line, however long. The interval join of parts and scopes is local to the document, since no
match spans lines: a document's blocks are its intervals, each block's roles are gathered once, and its weak candidates are
kept or dropped by them. So no row leaves its task, and neither repeated rows nor ids matter.

Fixed values of the base kinds are in BASE. Positions are code points, ends exclusive. They come from
the lengths of the text's pieces between matches, as both functions walk the same leftmost matches, added up in chunks of the
root of their number: a text of n matches copies n * sqrt(n) small elements, not n * n.

Edge cases: a null or empty text has no spans; repeated rows get the same spans each; ids are not read, so null and tied ones don't matter; an
empty table gives an empty result; other columns are kept untouched, whatever their names (one named as the result is replaced).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kind, pattern, group whose length counts, least length.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
#: The same matches, found faster: a run that is too short can't hold a longer one.
_SEARCH = {"access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}"}
#: Weak candidates: kind, pattern. Names may have any prefix.
WEAK = (
    ("user", r"""(?i)(?:user(?:_?name|_?id)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+._-]{3,}"""),
    ("key", r"""(?i)(?:pwd|pass(?:_?phrase)?|credentials?|[_-]key|accesskey|secretkey|privatekey|auth)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8,}"""),
    ("run", r"[A-Za-z0-9+/]{40,}={0,2}"),
    ("login", r"""://[^\x20\x09-\x0D"'<>/:@]{1,64}:[^\x20\x09-\x0D"'<>/@]{1,128}@"""),
    ("endpoint", r"""(?i)(?:https?|s?ftps?|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mariadb|mongodb(?:\+srv)?|rediss?|amqps?|ldaps?|smtps?)://[^\x20\x09-\x0D"'<>]+"""),
)
KINDS = tuple(k for k, *_ in BASE) + tuple(k for k, _ in WEAK)
ROLE = {"assign": "secret", "access": "access", "hex": "secret", "user": "identifier", "key": "secret", "run": "run", "login": "secret", "endpoint": "endpoint"}
#: Which roles complete a weak candidate. An address with a login is its own endpoint.
COMPLETED_BY = {"user": ("secret",), "key": ("access", "identifier", "endpoint"), "run": ("access",), "login": ("endpoint",), "endpoint": ("secret",)}
#: What parts two scopes: a blank line.
BLANK = r"\n[\x20\x09\x0B-\x0D]*\n"
MASK = "<secret>"
_SPAN = "struct<start:int,kind:int,end:int>"


def _bound(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _chunks(items: Column) -> Column:
    """The array in chunks of the root of its length, 64 at least; the last may be empty."""
    width = F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(items))).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(items) / width).cast("int")), lambda k: F.slice(items, k * width + 1, width))


def _running(items: Column, advance, emit, none: Column) -> Column:
    """What `emit` (an array) makes of each item and of the number carried so far, joined; `advance` carries it on from 0.
    Chunk by chunk, as an array that grows is copied with each element."""
    at = lambda value: value.cast("int").alias("at")

    def per_chunk(chunks: Column) -> Column:
        begin = F.struct(at(F.lit(0)), F.array().cast("array<int>").alias("out"))
        carried = F.aggregate(chunks, begin, lambda c, x: F.struct(at(F.aggregate(x, c["at"], advance)), F.concat(c["out"], F.array(c["at"])).alias("out")), lambda c: c["out"])
        step = lambda c, x: F.struct(at(advance(c["at"], x)), F.concat(c["out"], emit(c["at"], x)).alias("out"))
        return F.flatten(F.zip_with(chunks, carried, lambda x, first: F.aggregate(x, F.struct(at(first), none.alias("out")), step, lambda c: c["out"])))

    return _bound(items, lambda all_: _bound(_chunks(all_), per_chunk))


def _spans(text: Column, kind: str, pattern: str, group: int = 0, least: int = 0) -> Column:
    """Array of (start, kind number, end) of the pattern's matches whose group has at least `least` code points."""
    number, none = F.lit(KINDS.index(kind)), F.array().cast(f"array<{_SPAN}>")
    found = F.arrays_zip(
        F.slice(F.split(text, pattern, -1), 1, F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))).alias("before"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )

    def advance(at: Column, x: Column) -> Column:
        return at + F.length(x["before"]) + F.length(x["match"])

    def emit(at: Column, x: Column) -> Column:
        span = F.struct((at + F.length(x["before"])).alias("start"), number.alias("kind"), advance(at, x).alias("end"))
        return F.when(F.length(x["value"]) >= least, F.array(span)).otherwise(none)

    return F.when(text.rlike(pattern), _running(found, advance, emit, none)).otherwise(none)


def base_spans(text: Column) -> Column:
    """Spans of the base kinds, by start, then kind as listed."""
    text = F.coalesce(text, F.lit(""))
    each = (_spans(text, kind, _SEARCH.get(kind, pattern), group, least) for kind, pattern, group, least in BASE)
    return F.array_sort(F.concat(*each))


def blocks(text: Column) -> Column:
    """The text's scopes: array of (start, text), in order."""
    none = F.array().cast("array<struct<start:int,text:string>>")
    # A line feed stands for the gap behind the last block, where nothing follows.
    pieces = F.arrays_zip(F.split(text, BLANK, -1).alias("text"), F.concat(F.regexp_extract_all(text, F.lit(BLANK), F.lit(0)), F.array(F.lit("\n"))).alias("gap"))
    advance = lambda at, x: at + F.length(x["text"]) + F.length(x["gap"])
    return _running(pieces, advance, lambda at, x: F.array(F.struct(at.alias("start"), x["text"].alias("text"))), none)


def _completed(block: Column) -> Column:
    """A block's weak candidates that another part in it completes, at their places in the document."""
    text, none = block["text"], F.array().cast(f"array<{_SPAN}>")
    has = {kind: F.size(_spans(text, kind, _SEARCH.get(kind, pattern), group, least)) > 0 if least else text.rlike(pattern)
           for kind, pattern, group, least in (*BASE, *((k, p, 0, 0) for k, p in WEAK))}
    roles: dict[str, list[Column]] = {}
    for kind, role in ROLE.items():
        roles.setdefault(role, []).append(has[kind])

    def kept(kind: str, pattern: str) -> Column:
        completed = reduce(lambda a, b: a | b, (x for role in COMPLETED_BY[kind] for x in roles[role]))
        moved = F.transform(_spans(text, kind, pattern), lambda x: F.struct((x["start"] + block["start"]).alias("start"), x["kind"].alias("kind"), (x["end"] + block["start"]).alias("end")))
        return F.when(has[kind] & completed, moved).otherwise(none)

    return F.concat(*(kept(*x) for x in WEAK))


def linked(text: Column) -> Column:
    """Weak candidates that a complementary part in their block completes."""
    text, none = F.coalesce(text, F.lit("")), F.array().cast(f"array<{_SPAN}>")
    weak = reduce(lambda a, b: a | b, (text.rlike(p) for _, p in WEAK))
    return F.when(weak, F.flatten(F.transform(blocks(text), _completed))).otherwise(none)


def scan(docs: DataFrame, text: str = "text", secrets: str = "secrets") -> DataFrame:
    """docs and a struct column: base and all, arrays of spans (start, kind number, end) by start, then kind."""
    found = F.struct(base_spans(F.col(text)).alias("base"), linked(F.col(text)).alias("weak"))
    both = _bound(found, lambda x: F.struct(x["base"].alias("base"), F.array_sort(F.concat(x["base"], x["weak"])).alias("all")))
    return docs.withColumn(secrets, both)


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def redact(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", mask: str = MASK) -> DataFrame:
    """docs with a mask in place of each span (of overlapping ones, of their union), n_chars that of the new text."""
    name = "secrets"
    while name in docs.columns:
        name = f"_{name}"
    found = scan(docs, text, name)
    spans, some, whole = F.col(name)["all"], F.size(F.col(name)["all"]) > 0, F.col(text)
    kind = "struct<from:int,length:int>"
    advance = lambda at, x: F.greatest(at, x["end"])

    def gap(at: Column, x: Column) -> Column:
        """The stretch before a union of spans; also an empty one before the first."""
        stretch = F.struct(at.alias("from"), (x["start"] - at).alias("length"))
        return F.when((x["start"] > at) | (at == 0), F.array(stretch)).otherwise(F.array().cast(f"array<{kind}>"))

    behind = F.array_max(F.transform(spans, lambda x: x["end"]))
    rest = F.array(F.struct(behind.alias("from"), (F.length(whole) - behind).alias("length")))
    gaps = F.concat(_running(spans, advance, gap, F.array().cast(f"array<{kind}>")), rest)

    def cut(chunk: Column) -> Column:
        """The texts of a chunk of stretches, out of the part of the text that holds them."""
        first, last = F.get(chunk, 0), F.element_at(chunk, -1)
        part = F.substring(whole, first["from"] + 1, last["from"] + last["length"] - first["from"])
        return _bound(part, lambda p: F.transform(chunk, lambda x: F.substring(p, x["from"] - first["from"] + 1, x["length"])))

    pieces = _bound(gaps, lambda g: F.flatten(F.transform(F.filter(_chunks(g), lambda c: F.size(c) > 0), cut)))
    out = found.withColumn(text, F.when(some, F.array_join(pieces, mask)).otherwise(whole))
    if n_chars in docs.columns:
        out = out.withColumn(n_chars, F.when(some, F.length(text).cast(docs.schema[n_chars].dataType)).otherwise(F.col(n_chars)))
    return out.select(*(f"`{c}`" for c in docs.columns))


def oracle() -> str:
    """The query's result as DuckDB SQL."""

    def found(kind: str, pattern: str, group: int, least: int) -> str:
        p = pattern.replace("'", "''")
        return f"""select doc_id, text, {KINDS.index(kind)} as kind, {least} as least,
            regexp_extract_all(text, '{p}') as ms, regexp_extract_all(text, '{p}', {group}) as vs, string_split_regex(text, '{p}') as ps from d"""

    every = " union all ".join(found(*x) for x in (*BASE, *((k, p, 0, 0) for k, p in WEAK)))
    every += f""" union all select doc_id, text, -1, 0, regexp_extract_all(text, '{BLANK}'), regexp_extract_all(text, '{BLANK}'), string_split_regex(text, '{BLANK}') from d"""
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    role = "[" + ", ".join(f"'{ROLE[k]}'" for k in KINDS) + "]"
    needs = "[" + ", ".join(str(list(COMPLETED_BY.get(k, ("",)))) for k in KINDS) + "]"
    join = f"string_agg({names}[kind + 1] || ':' || s || ':' || e, ',' order by s, kind)"
    return f"""
    with d as (select doc_id, coalesce(text, '') as text from documents),
    m as ({every}),
    w as (select doc_id, kind, least, unnest(list_transform(range(len(ms)), lambda i: {{
        's': cast(list_sum(list_transform(ps[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i], lambda x: length(x))), 0) as bigint),
        'n': length(ms[i + 1]), 'v': length(vs[i + 1])}})) as x from m),
    q as (select doc_id, kind, x.s as s, x.s + x.n as e from w where x.v >= least),
    p as (select *, count(*) filter (kind = -1) over (partition by doc_id order by s, kind desc rows between unbounded preceding and current row) as block from q),
    b as (select doc_id, block, list(distinct {role}[kind + 1]) as roles from p where kind >= 0 group by doc_id, block),
    a as (select p.* from p join b using (doc_id, block) where kind >= 0 and (kind < {len(BASE)} or len(list_intersect(roles, {needs}[kind + 1])) > 0)),
    t as (select doc_id, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
        {join} filter (kind < {len(BASE)}) as base, {join} as spans from a group by doc_id)
    select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
        sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join t using (doc_id)"""
