"""Host-level quality rules on DataFrame functions alone.

Each document gets rule figures; failures are added up by host, each host's rate is drawn towards
the corpus rate by a beta prior that is fitted to the hosts themselves, and a host whose rate is
surely too high takes its documents with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, SPACES, let, materialise, text_of

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: A host is rejected if its shrunk failure rate less two standard deviations is above this.
MAX_HOST_RATE = 0.5
#: Rejected hosts are broadcast up to this count, else joined by a shuffle.
BROADCAST_HOSTS = 100_000
SYMBOLS = r"[#*$%&|<>]+"


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more; ``hashes`` has one for each window start."""
    numbered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        none = F.array(F.struct(F.lit(None).cast("long").alias("h"), F.lit(-1).alias("i")))
        around = F.zip_with(F.concat(none, F.slice(s, F.lit(1), F.size(s) - 1)), F.concat(F.slice(s, F.lit(2), F.size(s)), none), lambda a, b: F.struct(a["h"].alias("a"), b["h"].alias("b")))
        twice = F.filter(F.zip_with(s, around, lambda x, y: F.when(x["h"].eqNullSafe(y["a"]) | x["h"].eqNullSafe(y["b"]), x["i"])), lambda i: i.isNotNull())
        return F.sort_array(twice)

    def total(p: Column) -> Column:
        return F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")))["n"]

    return let(let(numbered, starts), total)


def rule_figures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` as the struct ``__row`` with the struct ``__q`` of figures.

    A null or empty text has no words: all its figures are 0 and it fails the word rule.
    """
    body = text_of(docs, text)
    cut = docs.select(F.struct("*").alias("__row"), body.alias("__text"), F.btrim(body, F.lit(SPACES)).alias("__trim"))
    cut = cut.select("__row", "__text", F.when(F.col("__trim") == "", F.array().cast("array<string>")).otherwise(F.split("__trim", SPACE_CLASS + "+")).alias("__words"))
    words, whole = F.col("__words"), F.col("__text")
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(hashed, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[h[i + j] for j in range(WINDOW)])))
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    cut = cut.select(
        "__row",
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        (F.octet_length(whole) - F.octet_length(F.regexp_replace(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.when(F.size(words) >= WINDOW, let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h)).otherwise(0))).otherwise(0).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return cut.select("__row", F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed")).alias("__q"))


def host_verdicts(figures: DataFrame) -> DataFrame:
    """One row for each host: documents, failures by rule, the prior, the shrunk rate and ``host_ok``.

    ``figures`` has ``host`` and the figures. Documents without a host form none.
    """
    hosts = figures.filter(F.col("host").isNotNull()).groupBy("host").agg(
        F.count("*").alias("n_docs"),
        F.count_if(F.col("n_words") < MIN_WORDS).alias("n_short"),
        F.count_if(100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")).alias("n_repeating"),
        F.count_if("base_failed").alias("n_failed"),
    )
    n, bad = F.col("n_docs"), F.col("n_failed")
    m = hosts.agg(F.count("*").alias("hosts"), F.sum("n_docs").alias("docs"), F.sum("n_failed").alias("bad"), F.sum(bad * bad / n).alias("square")).first()
    rate = (m.bad or 0) / m.docs if m.docs else 0.0
    noise = rate * (1 - rate)
    between = max(0.0, (m.square or 0.0) / m.docs - rate * rate - noise * m.hosts / m.docs) if m.docs else 0.0
    weight = min(1e6, max(1.0, noise / between - 1)) if between > 0 else 1e6
    a, b = rate * weight, (1 - rate) * weight
    shrunk = (bad + F.lit(a)) / (n + F.lit(a + b))
    spread = F.sqrt(F.col("host_rate") * (1 - F.col("host_rate")) / (n + F.lit(a + b + 1)))
    return hosts.withColumns({"prior_a": F.lit(a), "prior_b": F.lit(b), "host_rate": shrunk}).withColumn("host_ok", F.col("host_rate") - 2 * spread <= MAX_HOST_RATE)


def judge(docs: DataFrame, host: str = "source", text: str = "text", keep_columns: bool = True) -> DataFrame:
    """Every row of ``docs`` with its figures, ``base_failed``, ``host_rate`` and ``kept``.

    With ``keep_columns`` the input is in the struct ``__row`` and the rest in ``__q``; without, the
    columns are ``doc_id`` and the figures. Repeated rows count each; a null host is never rejected;
    an empty table gives no rows. Only rejected hosts are joined back, broadcast while few. Figures are
    written once, but never beside whole rows: with ``keep_columns`` they are computed again from the text.
    """
    figures = rule_figures(docs, text)
    row = F.col("__row") if keep_columns else F.struct(F.col("__row")["doc_id"].cast("long").alias("doc_id"))
    held = figures.select(row.alias("__row"), F.col("__row")[host].cast("string").alias("host"), "__q")
    told = materialise(held.select("host", "__q") if keep_columns else held, "figures")
    held = held if keep_columns else told
    hosts = materialise(host_verdicts(told.select("host", "__q.*")), "hosts")
    rejected = hosts.filter(~F.col("host_ok")).select("host", "host_rate")
    if rejected.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        rejected = F.broadcast(rejected)
    judged = held.join(rejected, "host", "left").select("__row", F.col("__q").withField("host_rejected", F.col("host_rate").isNotNull()).withField("kept", ~F.col("__q.base_failed") & F.col("host_rate").isNull()).alias("__q"))
    return judged if keep_columns else judged.select("__row.doc_id", "__q.*")


def filter_documents(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with the columns they came with."""
    return judge(docs, host, text).filter("__q.kept").select("__row.*")
