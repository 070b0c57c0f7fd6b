"""Quality rules as a short-circuit cascade; only DataFrame functions, no Python on the executors."""

from __future__ import annotations

import math
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, aside, let, words

WINDOW = 5
#: Rows at most of the sample that costs and rejections are estimated on, bytes at most of a text in it, and characters
#: at least that a measure is timed on. They set the order of the rules only.
SAMPLE_ROWS, SAMPLE_BYTES, TIMED_BYTES = 300, 100_000, 1_500_000
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_letters", "n_capitals"]


def repeat_words(w: Column) -> Column:
    """How many of a list of words are in windows that stand in it twice or more. Windows are told apart by 64-bit
    hashes; the work is one sort of them at most."""
    none = F.array().cast("array<struct<h: bigint, i: int>>")
    starts = F.sequence(F.lit(0), F.size(w) - WINDOW)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
    hashes = F.when(F.size(w) >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>"))

    def places(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), placed).otherwise(none)

    def twice(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, k + 1) | same(x, k - 1)), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        new = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(new, F.lit(0), lambda a, x: a + x)

    return let(hashes, lambda h: let(places(h), lambda s: let(twice(s), covered)))


def _lines(t: Column) -> Column:
    return F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")


def measures(text: Column) -> dict[str, Column]:
    """Each measure of a text by itself, from the text alone."""
    t = F.coalesce(text, F.lit(""))
    found = {
        "n_words": F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")),
        "word_chars": F.char_length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")),
        "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")),
        "n_dup_lines": let(_lines(t), lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_lines": F.size(_lines(t)),
        "n_repeat_words": let(words(text), repeat_words),
        "n_letters": F.char_length(F.regexp_replace(t, r"[^\p{L}]", "")),
        "n_capitals": F.char_length(F.regexp_replace(t, r"[^\p{Lu}]", "")),
    }
    return {k: v.cast("long") for k, v in found.items()}


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds MEASURES of a text column. A null text counts as empty: all zero. Very long texts stay in proportion."""
    return docs.withColumns(measures(F.col(text)))


def base_failed(m: dict[str, Column]) -> Column:
    return (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])


#: Each rule: the measures that it asks for, and what it rejects.
RULES = {
    "few_words": (["n_words"], lambda m: m["n_words"] < 10),
    "repeated_words": (["n_words", "n_repeat_words"], lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"]),
    "symbols": (["n_words", "n_symbols"], lambda m: 10 * m["n_symbols"] > m["n_words"]),
    "repeated_lines": (["n_dup_lines", "n_lines"], lambda m: (m["n_dup_lines"] > 0) & (10 * m["n_dup_lines"] > 3 * m["n_lines"])),
    "word_length": (["n_words", "word_chars"], lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 15 * m["n_words"])),
    "few_letters": (["word_chars", "n_letters"], lambda m: 10 * m["n_letters"] < 5 * m["word_chars"]),
    "capitals": (["n_letters", "n_capitals"], lambda m: 2 * m["n_capitals"] > m["n_letters"]),
}


def rules(m: dict[str, Column]) -> dict[str, Column]:
    """What each rule rejects, over measures that are worked out already."""
    return {name: reject(m) for name, (_, reject) in RULES.items()}


def by_rejection_per_cost(hits: dict[str, set], costs: dict[str, float], asks: dict[str, list[str]] | None = None, known=()) -> list[str]:
    """Rules in the order that rejects most for each second, where a rule is credited only with rows that the rules
    before it leave; ties by name. With asks, costs are of measures, and a rule costs those that it asks for and no rule
    before it did (nor are known)."""
    left, out, gone, known = sorted(hits), [], set(), set(known)

    def cost(name: str) -> float:
        return costs[name] if asks is None else max(1e-9, sum(costs[m] for m in asks[name] if m not in known))

    while left:
        best = min(left, key=lambda n: (-len(hits[n] - gone) / cost(n), cost(n), n))
        left.remove(best)
        out.append(best)
        gone |= hits[best]
        known |= set(asks[best]) if asks else set()
    return out


def order(docs: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS, known=()) -> list[str]:
    """The rules by rejections per second on a sample of at most `rows` texts; known: measures that are worked out anyway.

    Each measure is timed alone from the raw texts, less the time of the same job without one: the lesser of two runs over at
    least TIMED_BYTES, to the nearest power of four, so that the noise of a timing seldom turns the order.
    The sample is drawn at random from the first parts that have enough rows, so estimating does not read the
    whole table. It decides the order alone: the verdict is the same in any order.
    """
    drawn = docs.where(F.octet_length(text) <= SAMPLE_BYTES).select(F.col(text).alias("text")).sample(0.1, seed=7).head(rows)
    if not drawn:
        return sorted(RULES)
    sample = docs.sparkSession.createDataFrame([(k, r["text"]) for k, r in enumerate(drawn)], "k int, text string").coalesce(1)
    measured = measure(sample)
    flags = measured.select("k", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in rules({n: F.col(n) for n in MEASURES}).items()]).collect()
    times = max(1, -(-TIMED_BYTES // max(1, sum(len(r["text"] or "") for r in drawn))))
    many = sample.select("text", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("time"))

    def seconds(value: Column) -> float:
        took = []
        for _ in range(2):
            began = time.perf_counter()
            many.agg(F.sum(value)).first()
            took.append(time.perf_counter() - began)
        return min(took)

    nothing = seconds(F.char_length("text"))
    timed = {n: c for n, c in measures(F.col("text")).items() if n not in known}
    costs = {n: 4.0 ** round(math.log(max(1e-3, seconds(c) - nothing), 4)) for n, c in timed.items()} | {n: 0.0 for n in known}
    return by_rejection_per_cost({name: {r["k"] for r in flags if r[name]} for name in RULES}, costs, {n: asks for n, (asks, _) in RULES.items()}, known)


def cascade(docs: DataFrame, rules: dict[str, Column], names: list[str]) -> DataFrame:
    """Adds rejected_by: the first rule in the given order that rejects the row, else null; later rules are not
    evaluated for it. A rule that is null for a row doesn't reject it."""
    verdict = None
    for name in names:
        verdict = (F if verdict is None else verdict).when(F.coalesce(rules[name], F.lit(False)), F.lit(name))
    return docs.withColumn("rejected_by", F.lit(None).cast("string") if verdict is None else verdict)


def first_rejection(text: Column, names: list[str], known: dict[str, Column] | None = None) -> Column:
    """The first of the named rules, in their order, that rejects a text, else null. known: measures that are columns already.
    Any other is worked out once, when the first rule asks for it, and not at all for texts that rules before reject."""
    found = measures(text)

    def on(left: list[str], known: dict[str, Column]) -> Column:
        if not left:
            return F.lit(None).cast("string")
        asks, reject = RULES[left[0]]
        later = {m for n in left[1:] for m in RULES[n][0]}

        def bound(missing: list[str], known: dict[str, Column]) -> Column:
            if missing:
                return let(found[missing[0]], lambda x: bound(missing[1:], known | {missing[0]: x}))
            once = {m: found[m] for m in asks if m not in known}  # asked for by this rule alone
            return F.when(F.coalesce(reject(known | once), F.lit(False)), F.lit(left[0])).otherwise(on(left[1:], known))

        return bound([m for m in asks if m not in known and m in later], known)

    return on(names, known or {})


def judge(docs: DataFrame, text: str = "text", columns: list[str] = MEASURES) -> DataFrame:
    """Adds the measures named, base_failed, rejected_by and kept to documents.

    Every row gets a verdict; repeated rows get the same. Null and empty texts fail the base (no words). Columns of
    these names are replaced. What base_failed asks for is always among the measures; others that rules ask for are worked
    out as they are needed.
    """
    named = [n for n in MEASURES if n in columns or n in ("n_words", "n_repeat_words")]
    out = docs.withColumns({n: c for n, c in measures(F.col(text)).items() if n in named})
    known = {n: F.col(n) for n in named}
    out = out.withColumn("base_failed", base_failed(known))
    return out.withColumn("rejected_by", first_rejection(F.col(text), order(docs, text, known=named), known)).withColumn("kept", F.col("rejected_by").isNull())


def keep(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that judge() keeps, with their own columns. A measure is worked out when the first rule asks for it,
    and once, so a row that is rejected never has those of later rules."""
    plain, restore = aside(docs, text)
    return restore(plain.where(first_rejection(F.col(text), order(plain, text)).isNull()))


def op4_quality_cascade(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    asked = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judge(docs, columns=asked).select("doc_id", *asked, "base_failed", "kept")


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS s FROM w, unnest(range(1, len(ws) - 3)) AS u(i)),
twice AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, s) > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, unnest(range(0, 5)) AS v(k) GROUP BY rid),
m AS (SELECT doc_id, t, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
        len(ls) AS n_lines, coalesce(rep.n, 0) AS n_repeat_words,
        length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS letters, length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS capitals
      FROM w LEFT JOIN rep USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines OR word_chars < 2 * n_words
    OR word_chars > 15 * n_words OR 10 * letters < 5 * word_chars OR 2 * capitals > letters) AS kept
FROM b
"""
