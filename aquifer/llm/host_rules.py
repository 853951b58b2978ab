"""Quality rules judged with the record of the document's host.

Each document is measured against a few rules. Two of them reject on their own (too short, mostly
repeated); the others are soft: many clean texts break one by chance. For the soft rules the failures are
counted by domain, each domain's failure rate is shrunk towards the corpus by a beta prior that is
fitted to the domains' rates (method of moments), and a domain whose shrunk rate is high is taken to
break that rule by habit. The verdicts are joined back: a document goes if it fails a soft rule which
its host breaks by habit, or `many` soft rules whatever its host. A document that passes every rule
is always kept.

The bound of a habit is a fixed rate or, with `habit` None, follows from the fitted prior: the lower quartile of
the domain's posterior rate lies above the corpus mean (odds of three to one that the domain is worse). Where
the domains differ by no more than chance, none has a habit. With `gross`, a failure of one soft rule by far
rejects on any host.

Edge cases: a null text has no words and fails the length rule; a null domain is a domain of its own;
repeated rows are judged each for itself, alike; an empty table gives an empty result; columns of other
names are carried by `judge` only if they are listed in `keep`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aquifer.llm.common import SPACES, as_bytes, freeze, map_batches

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = "#*$%&|<>"

#: Soft rules: name -> SQL condition over the measures that holds when the rule fails.
SOFT_RULES = {
    "symbols": "n_symbols > 0.5 * n_words",
    "dup_lines": "n_dup_lines >= 3 and 20 * n_dup_lines > n_words",
    "repeats": "5 * n_repeat_words > n_words",
    "word_length": "word_chars < 2 * n_words or word_chars > 14 * n_words",
}
#: The same rules failed by far: a symbol a word, a repeated line for every five words, a third of the words repeated, and
#: words that no language has.
GROSS_RULES = {
    "symbols": "n_symbols > n_words",
    "dup_lines": "n_dup_lines >= 3 and 5 * n_dup_lines > n_words",
    "repeats": "3 * n_repeat_words > n_words",
    "word_length": "2 * word_chars < 3 * n_words or word_chars > 25 * n_words",
}
LOWER_QUARTILE = 0.6745  # of a normal posterior, in standard deviations below its mean
BASE_RULE = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more among `words`."""
    n = len(words)
    if n < 4:
        return 0
    first: dict[bytes, int] = {}
    ids = np.fromiter(map(first.setdefault, words, range(n)), np.int64, n)
    key = ids[:-2] * n + ids[1:-1]
    if n >= 2_000_000:  # keep the third word's product inside 64 bits
        key = np.unique(key, return_inverse=True)[1]
    key = key * n + ids[2:]
    order = np.argsort(key, kind="stable")
    same = np.diff(key[order]) == 0
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k:n - 2 + k] |= twice
    return int(inside.sum())


def measure(text: bytes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text."""
    words = text.split()
    seen: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    chars = len(text.decode("utf-8", "replace")) - sum(text.count(c.encode()) for c in SPACES)
    return len(words), chars, sum(text.count(c.encode()) for c in SYMBOLS), dup, repeated_words(words)


def measured(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """`keep` columns and the measures of every row, frozen in the shared folder (no texts)."""
    narrow = docs.select(*keep, F.col(text).alias("__text"))
    kept = [f for f in narrow.schema.fields if f.name != "__text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([measure(t) for t in as_bytes(b, "__text")], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays(
                [b.column(f.name) for f in kept] + [pa.array(rows[:, k]) for k in range(len(MEASURES))],
                names=[*(f.name for f in kept), *MEASURES])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{m} long" for m in MEASURES])
    return freeze(map_batches(narrow, run, schema), "measures")


def host_rates(rows: DataFrame, domain: str) -> DataFrame:
    """One row per (domain, rule): documents, failures, raw and shrunk failure rate, the rate's lower quartile, corpus mean.

    The beta prior of a rule has the mean of the whole corpus and the size that the spread of the domains'
    rates, weighted by their documents and less their sampling noise, asks for.
    """
    sums = rows.groupBy(F.col(domain).alias("domain")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.expr(cond)).alias(rule) for rule, cond in SOFT_RULES.items()])
    stacked = sums.select("domain", "n", F.explode(F.create_map(
        *[x for rule in SOFT_RULES for x in (F.lit(rule), F.col(rule))])).alias("rule", "failures"))
    prior = stacked.groupBy("rule").agg(
        (F.sum("failures") / F.sum("n")).alias("mu"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("domains"),
        F.sum(F.col("failures") * F.col("failures") / F.col("n")).alias("square"))
    noise = F.col("mu") * (1 - F.col("mu")) * F.col("domains") / F.col("total")
    spread = F.greatest(F.col("square") / F.col("total") - F.col("mu") * F.col("mu") - noise, F.lit(1e-9))
    strength = F.least(F.greatest(F.col("mu") * (1 - F.col("mu")) / spread - 1, F.lit(1.0)), F.lit(1e6))
    prior = prior.select("rule", "mu", strength.alias("strength"))
    shrunk = (F.col("failures") + F.col("mu") * F.col("strength")) / (F.col("n") + F.col("strength"))
    deviation = F.sqrt(F.col("shrunk") * (1 - F.col("shrunk")) / (F.col("n") + F.col("strength") + 1))
    return stacked.join(prior, "rule").select(
        "domain", "rule", "n", "failures", (F.col("failures") / F.col("n")).alias("rate"), shrunk.alias("shrunk"),
        "mu", "strength").select(
        "domain", "rule", "n", "failures", "rate", "shrunk", (F.col("shrunk") - LOWER_QUARTILE * deviation).alias("low"), "mu")


def judge(docs: DataFrame, domain: str = "source", text: str = "text", keep: list[str] = ["doc_id"],
          habit: float | None = 0.4, many: int = 3, gross: bool = False) -> DataFrame:
    """Every row's measures, `base_failed` and `kept`.

    habit: a domain whose shrunk failure rate of a soft rule is above this breaks the rule by habit; None: the bound
        that follows from the fitted prior.
    many: so many soft failures reject a document on any host.
    gross: a gross failure of one soft rule rejects a document on any host.
    """
    carried = [F.col(c) for c in keep] + [F.col(domain).alias("__domain")]
    rows = measured(docs.select(*carried, F.col(text).alias("__raw")), [*keep, "__domain"], "__raw")
    bound = F.col("low") > F.col("mu") if habit is None else F.col("shrunk") > habit
    verdicts = (host_rates(rows, "__domain").where(bound)
                .groupBy("domain").agg(F.collect_set("rule").alias("habits")))  # at most one entry per rule
    failed = F.filter(F.array(*[F.when(F.expr(cond), F.lit(rule)) for rule, cond in SOFT_RULES.items()]),
                      lambda x: x.isNotNull())
    joined = rows.join(verdicts, rows["__domain"].eqNullSafe(verdicts["domain"]), "left")
    base = F.expr(BASE_RULE)
    bad = F.coalesce(F.arrays_overlap(failed, F.col("habits")), F.lit(False)) | (F.size(failed) >= many)
    if gross:
        for cond in GROSS_RULES.values():
            bad |= F.expr(cond)
    return joined.select(*keep, *MEASURES, base.alias("base_failed"), (~base & ~bad).alias("kept"))
