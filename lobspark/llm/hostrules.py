"""Quality rules of documents, judged again by the host they come from.

Every document is measured inside its own row with built-in functions. Failures of each rule are summed by host, and
a host's rate is shrunk towards all hosts' by a beta prior. Its two moments are means over the hosts of two rows and more, each host
counting once: k / n estimates a host's rate and k (k - 1) / (n (n - 1)) its square, both without bias. So a page says less than a long
record, a large host is judged by its own, and no hot host makes the prior.

Scale: texts are read once; only counts are written, summed (map-side) and joined. Just the hosts with a verdict against them are
joined back, under a salt, so a host with a third of all rows is split over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lobspark.session import materialize

#: A host's shrunk rate of base failures above which all of its documents go, and its rate of any rule above
#: which its documents that fail this rule go.
REJECT_AT, DOUBT_AT = 0.8, 0.3
SALTS = 32

#: Rules judged by host; a document that fails one still stays unless its host is doubtful under the same rule.
RULES = {
    "base": "base_failed",
    "symbols": "10 * n_symbols > n_words",
    "lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "n_words > 0 and (word_chars < 3 * n_words or word_chars > 10 * n_words)",
}


def _repeated(ordered: str) -> Column:
    """Places of windows that stand next to an equal one in the sorted array of (window, place), ascending."""
    return F.expr(f"sort_array(transform(filter({ordered}, (x, k) -> x.g = get({ordered}, k - 1).g or x.g = get({ordered}, k + 1).g), x -> x.at))")


def measured(docs: DataFrame, carry: list[str], host: str = "source") -> DataFrame:
    """``row, host`` and every count of a document's text, all from built-in functions."""
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(f"`{host}`").cast("string").alias("host"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    d = d.select(
        "row",
        "host",
        F.expr(r"array_remove(split(text, '[ \\t-\\r]+'), '')").alias("words"),
        F.expr(r"filter(split(text, '\\n'), x -> x rlike '[^ \\t-\\r]')").alias("lines"),
        (F.size(F.split("text", r"[#*$%&|<>]")) - 1).cast("long").alias("n_symbols"),
    )
    windows = "transform(slice(words, 1, greatest(size(words) - 2, 0)), (x, i) -> struct(concat_ws(' ', x, words[i + 1], words[i + 2]) as g, i as at))"
    d = d.select(
        "row",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.expr("aggregate(words, 0L, (n, x) -> n + char_length(x))").alias("word_chars"),
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(f"sort_array({windows})").alias("ordered"),
    )
    places = d.withColumn("at", _repeated("ordered")).drop("ordered")
    covered = "aggregate(at, struct(0L as n, -3 as last), (s, p) -> struct(s.n + least(3, p - s.last) as n, p as last), s -> s.n)"
    return places.withColumn("n_repeat_words", F.expr(covered)).drop("at").withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


def host_rates(rows: DataFrame) -> DataFrame:
    """One row per host: documents ``n``, failures ``k_<rule>`` and shrunk rates ``rate_<rule>`` of each rule."""
    hosts = rows.groupBy("host").agg(F.count("*").alias("n"), *[F.sum(F.expr(rule).cast("long")).alias(f"k_{r}") for r, rule in RULES.items()])
    several = F.col("n") > 1
    # decimals, so that sums do not depend on the order of the hosts
    rate = lambda r: F.avg(F.when(several, F.expr(f"cast(k_{r} / n as decimal(28,18))"))).cast("double")
    square = lambda r: F.avg(F.when(several, F.expr(f"cast((k_{r} / n) * ((k_{r} - 1) / nullif(n - 1, 0)) as decimal(28,18))"))).cast("double")
    pooled = lambda r: F.sum(f"k_{r}").cast("double") / F.sum("n").cast("double")
    whole = hosts.agg(*[x for r in RULES for x in (F.coalesce(rate(r), pooled(r)).alias(f"mean_{r}"), square(r).alias(f"square_{r}"))])
    out = hosts.crossJoin(F.broadcast(whole))  # one row
    for r in RULES:
        out = out.withColumn("m1", F.col(f"mean_{r}")).withColumn("m2", F.col(f"square_{r}"))
        out = out.withColumn("strength", F.expr("case when m2 > m1 * m1 then (m1 - m2) / (m2 - m1 * m1) end"))
        out = out.withColumn(f"rate_{r}", F.expr(f"case when strength is null then m1 else (k_{r} + m1 * strength) / (n + strength) end"))
    return out.select("host", "n", *[f"k_{r}" for r in RULES], *[f"rate_{r}" for r in RULES])


def host_verdicts(rates: DataFrame, reject_at: float = REJECT_AT, doubt_at: float = DOUBT_AT) -> DataFrame:
    """``host, host_verdict, doubt_<rule>``: 'rejected', 'doubtful' (under the marked rules) or 'trusted'."""
    out = rates.select("host", (F.col("rate_base") > reject_at).alias("rejected"), *[(F.col(f"rate_{r}") > doubt_at).alias(f"doubt_{r}") for r in RULES])
    doubtful = " or ".join(f"doubt_{r}" for r in RULES)
    return out.select("host", F.expr(f"case when rejected then 'rejected' when {doubtful} then 'doubtful' else 'trusted' end").alias("host_verdict"), *[f"doubt_{r}" for r in RULES])


def host_rules(docs: DataFrame, carry: list[str] | None = None, host: str = "source", reject_at: float = REJECT_AT, doubt_at: float = DOUBT_AT) -> DataFrame:
    """Counts, base rule and verdict of every row: ``row, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed, host_verdict, kept``.

    ``docs`` has ``text`` and the column named by ``host``; the columns named by ``carry`` (``doc_id`` if none) come back in ``row``.
    A row is kept unless it fails the base rule, its host is rejected, or its host is doubtful under a rule that it fails.

    Defined cases: a null or empty text has no words, all counts zero, and fails the base rule; a text of fewer than three words
    has no window; rows without a host form one host; repeated rows count as often as they stand; where hosts
    differ no more than chance would have it, each has their mean rate, and where every host has one row the pooled rate; an empty table gives no rows.
    """
    rows = materialize(measured(docs, carry or ["doc_id"], host))
    against = host_verdicts(host_rates(rows), reject_at, doubt_at).where("host_verdict <> 'trusted'")
    against = against.withColumnRenamed("host", "h").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("s", F.pmod(F.xxhash64("row", "n_words", "word_chars"), F.lit(SALTS)).cast("int"))
    out = salted.join(against, F.col("host").eqNullSafe(F.col("h")) & (F.col("s") == F.col("salt")), "left")
    fails = " or ".join(f"(doubt_{r} and ({rule}))" for r, rule in RULES.items())
    verdict = F.coalesce("host_verdict", F.lit("trusted")).alias("host_verdict")
    kept = F.expr(f"not base_failed and not coalesce(host_verdict = 'rejected' or {fails}, false)").alias("kept")
    return out.select("row", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", verdict, kept)
