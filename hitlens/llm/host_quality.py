"""Quality rules with host verdicts.

Each document is measured on its whole text and tested by four rules, each a share that must not pass a limit. Failures are
summed by host, and each host's failure rate is shrunk towards the corpus by a beta prior fitted to the hosts: the intraclass correlation
of the one-way analysis of variance, which takes the sampling noise of small hosts off, gives the prior's weight. Hosts
that differ by noise alone are all put at the corpus rate.

The host's verdict is a tighter limit: at a host whose shrunk rate for a rule is above the corpus rate, the limit falls
by the square root of their quotient, down to `LEAST_CUT` of itself. It is joined back to the documents, so a document that fails a rule goes wherever it
comes from, one that comes near to failing goes at a bad host, and a clean one stays at any host.

Scale: texts are walked once; their measures are staged beside them. Per-host counts combine map-side, so a host with a third of all
rows is one row per task. Only documents within reach of a tighter limit meet the hosts; the others are not shuffled.

Edge cases: a null or empty text has no words and fails the base rules; a null host is a host of its own;
repeated rows are measured and counted each; an empty table gives an empty result; other columns are kept
untouched, whatever their names (the operator's own columns live in one struct, `quality`, whose name can be changed).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import stage
from .text import texts

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
RULES = ("short", "repetition", "symbols", "dup_lines")
#: Thousandths of a rule's limit that are left at the worst hosts, and bounds of the prior's weight in documents.
LEAST_CUT, LEAST_WEIGHT, MAX_WEIGHT = 700, 1.0, 1e6


def measure(text: str) -> tuple[int, int, int, int, int, int]:
    raw = text.encode()
    words = raw.split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    n_symbols = sum(map(text.count, "#*$%&|<>"))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = 0
    if n > 3:
        ids: dict[bytes, int] = {}
        word = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
        pair = np.unique(word[:-1] * len(ids) + word[1:], return_inverse=True)[1]
        _, window, count = np.unique(pair[:-1] * len(ids) + word[2:], return_inverse=True, return_counts=True)
        if len(count) < n - 2:
            again = count[window] > 1
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : n - 2 + k] |= again
            repeated = int(covered.sum())
    return n, word_chars, n_symbols, len(lines) - len(set(lines)), repeated, len(lines)


def _measure_batch(column: pa.Array) -> pa.Array:
    rows = np.array([measure(x) for x in texts(column)], np.int64).reshape(-1, len(MEASURES))
    return pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(MEASURES))], list(MEASURES))


def measures(text: Column) -> Column:
    kind = T.StructType([T.StructField(m, T.LongType()) for m in MEASURES])
    return F.arrow_udf(_measure_batch, kind)(text)


def share(name: str, m: Column) -> tuple[Column, Column]:
    """(a, b): a document with measures m fails the rule where a > b."""
    return {
        "short": (F.lit(50), m["n_words"]),
        "repetition": (100 * m["n_repeat_words"], 50 * m["n_words"]),
        "symbols": (20 * m["n_symbols"], m["word_chars"]),
        "dup_lines": (2 * m["n_dup_lines"], m["n_lines"]),
    }[name]


def rule(name: str, m: Column, cut: Column | int = 1000) -> Column:
    """Whether a document with measures m fails the rule at so many thousandths of its limit."""
    a, b = share(name, m)
    return 1000 * a > cut * b


def base_failed(m: Column) -> Column:
    return rule("short", m) | rule("repetition", m)


def host_verdicts(measured: DataFrame, host: str, m: str) -> DataFrame:
    """One row per host and rule: host, rule, n_docs, n_failed, rate (shrunk), cut (thousandths of the rule's limit)."""
    by_host = measured.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n_docs"), *(F.sum(rule(r, F.col(m)).cast("long")).alias(r) for r in RULES)
    )
    long = by_host.select(
        "host", "n_docs", F.explode(F.map_from_arrays(F.array(*map(F.lit, RULES)), F.array(*RULES))).alias("rule", "n_failed")
    )
    n, f = F.col("n_docs").cast("double"), F.col("n_failed").cast("double")
    sums = long.groupBy("rule").agg(F.sum(n).alias("n"), F.sum(f).alias("f"), F.sum(f * f / n).alias("q"), F.sum(n * n).alias("n2"), F.count(F.lit(1)).cast("double").alias("k"))
    # Mean squares between and within hosts, and the hosts' mean size as the analysis of variance weighs it.
    between = "((q - f * f / n) / (k - 1))"
    within, size = "((f - q) / (n - k))", "((n - n2 / n) / (k - 1))"
    weight = f"""CASE WHEN k > 1 AND n > k THEN CASE WHEN {between} > {within}
        THEN least({MAX_WEIGHT}D, greatest({LEAST_WEIGHT}D, ({between} + ({size} - 1) * {within}) / ({between} - {within}) - 1)) ELSE {MAX_WEIGHT}D END ELSE {MAX_WEIGHT}D END"""
    prior = sums.select("rule", F.expr("f / n").alias("prior_rate"), F.expr(weight).alias("prior_weight"))
    shrunk = (f + F.col("prior_rate") * F.col("prior_weight")) / (n + F.col("prior_weight"))
    cut = F.when(F.col("rate") > F.col("prior_rate"), F.greatest(F.lit(LEAST_CUT), F.floor(1000 * F.sqrt(F.col("prior_rate") / F.col("rate")) + 0.5).cast("int"))).otherwise(1000)
    return (
        long.join(F.broadcast(prior), "rule")  # one row per rule
        .withColumn("rate", shrunk)
        .select("host", "rule", "n_docs", "n_failed", "rate", cut.alias("cut"))
    )


def judge(docs: DataFrame, text: str = "text", host: str = "source", quality: str = "quality", drop_text: bool = False) -> DataFrame:
    """docs (without their texts, if asked) and a struct column `quality`: the measures, base_failed and kept."""
    taken = {c.lower() for c in docs.columns}
    raw, key, cuts = "measures", "host_key", "host_cuts"
    while taken & {raw, key, cuts}:
        raw, key, cuts = raw + "_", key + "_", cuts + "_"
    measured = docs.withColumn(raw, measures(F.col(text)))
    measured = stage(measured.drop(text) if drop_text else measured, "measured")
    tighter = host_verdicts(measured, host, raw).filter("cut < 1000")
    tighter = tighter.groupBy(F.struct("host").alias(key)).pivot("rule", list(RULES)).agg(F.first("cut"))
    tighter = tighter.select(key, F.struct(*(F.coalesce(F.col(r), F.lit(1000)).alias(r) for r in RULES)).alias(cuts))
    m = F.col(raw)
    base = base_failed(m)

    def verdict(frame: DataFrame, cut) -> DataFrame:
        failed = base
        for r in RULES:
            failed = failed | rule(r, m, cut(r))
        fields = [m[x].alias(x) for x in MEASURES]
        return frame.withColumn(quality, F.struct(*fields, base.alias("base_failed"), (~failed).alias("kept"))).drop(raw, key, cuts)

    # A host changes the verdict of documents that pass every rule and would fail one at the least cut.
    failed, near = F.lit(False), F.lit(False)
    for r in RULES:
        failed, near = failed | rule(r, m), near | rule(r, m, LEAST_CUT)
    open_ = near & ~failed
    met = measured.filter(open_).join(tighter, F.struct(F.col(host).alias("host")).eqNullSafe(F.col(key)), "left")
    return verdict(measured.filter(~open_), lambda r: F.lit(1000)).unionByName(verdict(met, lambda r: F.coalesce(F.col(cuts)[r], F.lit(1000))))


def keep(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The documents that pass, with the columns they had."""
    name = "quality"
    while name in docs.columns:
        name = f"_{name}"
    return judge(docs, text, host, name).filter(F.col(name)["kept"]).drop(name)


def oracle() -> str:
    """The query's result as DuckDB SQL."""
    word = r"[^\x20\x09-\x0D]+"
    shares = {"short": ("50", "n_words"), "repetition": ("100 * n_repeat_words", "50 * n_words"), "symbols": ("20 * n_symbols", "word_chars"), "dup_lines": ("2 * n_dup_lines", "n_lines")}
    rates = " union all ".join(f"select source, '{r}' as rule, cast(count(*) as double) as n, cast(count(*) filter ({a} > {b}) as double) as f from m group by source" for r, (a, b) in shares.items())
    base = " or ".join(f"{a} > {b}" for a, b in (shares["short"], shares["repetition"]))
    fails = " or ".join(f"1000 * {a} > coalesce(cut_{r}, 1000) * {b}" for r, (a, b) in shares.items())
    cuts = ", ".join(f"max(cut) filter (rule = '{r}') as cut_{r}" for r in shares)
    between, within, size = "((q - f * f / n) / (k - 1))", "((f - q) / (n - k))", "((n - n2 / n) / (k - 1))"
    return f"""
    with d as (select doc_id, source, coalesce(text, '') as t from documents),
    w as (select doc_id, source, t, regexp_extract_all(t, '{word}') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) as ls from d),
    g as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as run from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w)),
    again as (select doc_id, i from g qualify count(*) over (partition by doc_id, run) > 1),
    covered as (select doc_id, count(distinct i + k) as n from again, (values (0), (1), (2)) as v(k) group by doc_id),
    m as (select doc_id, source, len(ws) as n_words, coalesce(cast(list_sum(list_transform(ws, lambda x: length(x))) as bigint), 0) as word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols, len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(n, 0) as n_repeat_words, len(ls) as n_lines
        from w left join covered using (doc_id)),
    r as ({rates}),
    sums as (select rule, sum(n) as n, sum(f) as f, sum(f * f / n) as q, sum(n * n) as n2, cast(count(*) as double) as k from r group by rule),
    prior as (select rule, f / n as p, case when k > 1 and n > k then case when {between} > {within}
        then least({MAX_WEIGHT}, greatest({LEAST_WEIGHT}, ({between} + ({size} - 1) * {within}) / ({between} - {within}) - 1)) else {MAX_WEIGHT} end else {MAX_WEIGHT} end as weight from sums),
    rate as (select source, rule, p, (f + p * weight) / (n + weight) as rate from r join prior using (rule)),
    cut as (select source, rule, case when rate > p then greatest({LEAST_CUT}, cast(floor(1000 * sqrt(p / rate) + 0.5) as integer)) else 1000 end as cut from rate),
    host as (select source, {cuts} from cut group by source)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({base}) as base_failed, not ({base} or {fails}) as kept
    from m left join host on m.source is not distinct from host.source"""
