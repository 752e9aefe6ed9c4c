"""Quality rules as a bitmask ledger, in DataFrame functions alone.

Every rule is evaluated once per document into one bit of ``failed_bits``, beside its measurements.
A policy version is a mask of bits: a document is kept when ``failed_bits & mask = 0``. Changing a
policy, or asking what each rule costs, reads the ledger and never the text again.

Words are ``[^\\x20\\x09-\\x0D]+``. Null and empty texts have no words and fail ``few_words``.
Repeated rows each get their row; extra columns stay with ``with_ledger``, and those whose names its
own columns take are renamed with ``_input`` behind them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.io import rename_clashing

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: name -> condition on the measurements under which the rule fails; the order gives the bit.
RULES: dict[str, str] = {
    "few_words": "q_n_words < 20",
    "repeated_words": "100 * q_n_repeat_words > 30 * q_n_words",
    "many_symbols": "10 * q_n_symbols > q_word_chars",
    "repeated_lines": "q_n_dup_lines >= 4 and 2 * q_n_dup_lines > q_n_lines",
    "long_words": "q_word_chars > 40 * q_n_words",
    "shouting": "2 * q_n_capitals > q_word_chars",
}
#: version -> rules in force.
POLICIES: dict[str, list[str]] = {
    "base": ["few_words", "repeated_words"],
    "v1": ["few_words", "repeated_words", "many_symbols", "repeated_lines"],
    "v2": list(RULES),
}


def mask_of(names: list[str]) -> int:
    return sum(1 << list(RULES).index(n) for n in names)


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, evaluated once however often body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of eight which occurs twice or more. Windows are compared by hash
    first: distinct hashes prove distinct windows, and the others are compared as text."""

    def count(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - (WINDOW - 1))
        hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
        return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(exact(w, starts)))

    def exact(w: Column, starts: Column) -> Column:
        windows = F.sort_array(F.transform(starts, lambda i: F.struct(F.array_join(F.slice(w, i, WINDOW), " ").alias("w"), i.alias("i"))))

        def covered(s: Column) -> Column:
            def twice(x: Column, k: Column) -> Column:
                return ((k > 0) & (F.get(s, k - 1)["w"] == x["w"])) | ((k < F.size(s) - 1) & (F.get(s, k + 1)["w"] == x["w"]))

            at = F.sort_array(F.transform(F.filter(s, twice), lambda x: x["i"]))
            step = lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last"))
            return F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), step, lambda a: a["n"])

        return _let(windows, covered)

    return F.when(F.size(words) < WINDOW + 1, F.lit(0)).otherwise(count(words))


def _line_counts(text: Column) -> Column:
    """(lines with a word, those that equal an earlier one)."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, SPACE, "") != "")
    return _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))


ADDED = ["q_n_words", "q_n_repeat_words", "q_n_lines", "q_n_dup_lines", "q_word_chars", "q_n_symbols", "q_n_capitals", "q_failed_bits"]


def measurements(text: Column, words_name: str = "q_words", lines_name: str = "q_lines") -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    packed = F.translate(text, SPACE, "")
    words = _let(_words(text), lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("rep")))
    return {words_name: words, lines_name: _line_counts(text), "q_word_chars": F.length(packed).cast("long"), "q_n_symbols": F.length(text).cast("long") - F.length(F.translate(text, SYMBOLS, "")), "q_n_capitals": F.length(text).cast("long") - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))}


def with_ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with its measurements (q_*) and ``q_failed_bits``. A narrow projection: no shuffle."""
    docs = rename_clashing(docs, ADDED)
    behind = "_"
    while any(c.lower() in (f"q_words{behind}", f"q_lines{behind}") for c in docs.columns):
        behind += "_"
    words, lines = f"q_words{behind}", f"q_lines{behind}"
    out = docs.withColumns(measurements(F.col(text), words, lines))
    counts = {"q_n_words": (words, "n"), "q_n_repeat_words": (words, "rep"), "q_n_lines": (lines, "n"), "q_n_dup_lines": (lines, "dup")}
    out = out.withColumns({n: F.col(c)[f].cast("long") for n, (c, f) in counts.items()}).drop(words, lines)
    bits = [F.when(F.expr(rule), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")) for k, rule in enumerate(RULES.values())]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return out.withColumn("q_failed_bits", total)


def keeps(version: str) -> Column:
    return F.col("q_failed_bits").bitwiseAND(F.lit(mask_of(POLICIES[version])).cast("long")) == 0


def ablations(ledger: DataFrame, version: str) -> DataFrame:
    """For each rule of a policy: documents it fails, documents that only it rejects, and documents
    kept without it. One aggregation to at most 2**len(RULES) distinct masks, then sums over those."""
    seen = ledger.groupBy("q_failed_bits").agg(F.count("*").alias("n"))
    mask = mask_of(POLICIES[version])
    bits = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << list(RULES).index(r)).cast("long").alias("bit")) for r in POLICIES[version]])
    per = seen.withColumn("r", F.explode(bits)).select("n", "r.rule", "r.bit", F.col("q_failed_bits").bitwiseAND(F.lit(mask).cast("long")).alias("m"))
    hit = F.col("m").bitwiseAND(F.col("bit")) != 0
    return per.groupBy("rule").agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("failed"), F.sum(F.when(F.col("m") == F.col("bit"), F.col("n")).otherwise(0)).alias("only_this"), F.sum(F.when(F.col("m").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, F.col("n")).otherwise(0)).alias("kept_without"))
