"""Toxicity of whole texts by a small convolutional network, trained in numpy.

Words are hashed twice into one table of embeddings and the two rows are added, so that a rare word that
shares a row with a telling one does not look like it. Filters over one, two and three words slide over the
whole text; each filter's largest value (max pooling) goes into a logistic output. The first dimension of the
embeddings starts from the smoothed log-odds of the hashed word in toxic and other training texts, the
rest at random; all of it is trained. Every language has its own threshold, calibrated on all labelled training
rows that the fit did not see, whole texts of any length; the language is told from the text's own function words. A score is the logistic of the
margin over that threshold, so 0.5 is the threshold everywhere.

Learning uses a bounded sample of the labelled rows outside the held-out fold: up to `sample` rows of each
label, the first in a hash order of the ids, of at most `longest` words; a quarter of it is left to the thresholds, so that
they have rows on small tables. Margins are found once a text; the thresholds come from their counts in fine bins by
language and label, where short rows stand in for the fit's rows of their label. Scoring reads every text whole.
Labels, language and source columns and ids are never inputs of a score.

Edge cases: a null or empty text has no words and gets the score of its empty features; labels that are null or
without a document are left out, a document with several labels is toxic if one says so; without labels
of both kinds every row gets the smoothed share of toxic labels; repeated rows get equal scores.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aquifer.llm.common import as_bytes, fold, freeze, map_batches, slices

WORDS = re.compile(rb"[a-z0-9\x80-\xff]+")

#: Function words that tell the language of a text (fixed values, the most common words of each language).
FUNCTION_WORDS = {
    "de": "der die und den von zu das sich mit des auf für ist im nicht dem ein eine als auch es an werden aus er hat",
    "en": "the of and to in is that it for was on with as be by are this at from or an not have which but had his",
    "es": "el la de que y los las se del un por con una su para al lo como más o pero sus le ha este sí porque",
    "fr": "le la les et des en un du une que est pour par dans avec qui pas sur au plus ne ce se sont il cette",
}
LANGUAGES = ("other", *FUNCTION_WORDS)
BITS = 18  # of a row number in the embedding table
WIDTHS = (1, 2, 3)
PAD = max(WIDTHS) - 1
#: Bins of a margin for the thresholds: so many to one, up to a margin of RANGE either side; a fixed number in all.
BINS, RANGE = 512, 32
LEAST_TOXIC = 20  # rows of a language with its own threshold


def _language_bits() -> dict[bytes, int]:
    """Word -> bit set of the languages that have it as a function word."""
    marks: dict[bytes, int] = {}
    for k, words in enumerate(FUNCTION_WORDS.values()):
        for w in words.split():
            marks[w.encode()] = marks.get(w.encode(), 0) | 1 << k
    return marks


class Words(dict):
    """Word -> its two rows in the embedding table and its language bits, packed in one integer."""

    marks = _language_bits()

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        first, second = h & (1 << BITS) - 1, (h >> BITS & (1 << BITS) - 1) + (1 << BITS)
        got = self[word] = first | second << (BITS + 1) | self.marks.get(word, 0) << (2 * BITS + 2)
        return got

    def of(self, text: bytes) -> np.ndarray:
        found = WORDS.findall(text.decode("utf-8", "replace").lower().encode())
        return np.fromiter(map(self.__getitem__, found), np.int64, len(found))


def rows_of(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = (1 << BITS + 1) - 1
    return packed & mask, packed >> (BITS + 1) & mask


def language_of(packed: np.ndarray) -> int:
    """Index in LANGUAGES of the language with most function words in the text; 0 without any."""
    bits = packed >> (2 * BITS + 2)
    counts = [int((bits >> k & 1).sum()) for k in range(len(FUNCTION_WORDS))]
    return int(np.argmax(counts)) + 1 if max(counts) else 0


class Network:
    """Hashed embeddings, filters of several widths, max pooling, logistic output."""

    def __init__(self, dim: int = 8, filters: int = 8, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.05, (2 << BITS, dim)).astype(np.float32)
        self.filters = [rng.normal(0, 0.2, (w, dim, filters)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(filters, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.2, filters * len(WIDTHS)).astype(np.float32)
        self.const = 0.0
        for f in self.filters:  # the first filter of each width starts by reading the log-odds
            f[:, :, 0] = 0
            f[:, 0, 0] = 1.0
        self.out[::filters] = 1.0
        self.thresholds = np.zeros(len(LANGUAGES))

    def embed(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of all texts behind one another, each followed by PAD zero rows; starts and lengths."""
        sizes = np.array([len(t) for t in texts], np.int64)
        starts = np.cumsum(sizes + PAD) - sizes - PAD
        words = np.zeros((int((sizes + PAD).sum()), self.table.shape[1]), np.float32)
        first, second = rows_of(np.concatenate(texts) if texts else np.empty(0, np.int64))
        where = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        words[where] = self.table[first] + self.table[second]
        return words, starts, sizes

    def responses(self, words: np.ndarray, k: int) -> np.ndarray:
        w, n = WIDTHS[k], len(words) - PAD
        got = words[:n] @ self.filters[k][0]
        for j in range(1, w):
            got += words[j:n + j] @ self.filters[k][j]
        return got + self.bias[k]

    def features(self, texts: list[np.ndarray], places: bool = False):
        """Pooled features of each text; with `places` also the word where each filter is largest."""
        words, starts, sizes = self.embed(texts)
        if not places:  # in double precision, a text's score does not depend on the texts beside it
            words = words.astype(np.float64)
        f = self.out.size // len(WIDTHS)
        out = np.zeros((len(texts), self.out.size), words.dtype)
        at = np.zeros((len(texts), self.out.size), np.int64)
        full = np.flatnonzero(sizes)
        if len(full):
            for k in range(len(WIDTHS)):
                got = self.responses(words, k)
                cols = slice(k * f, (k + 1) * f)
                if places:
                    for i in full:
                        part = got[starts[i]:starts[i] + sizes[i]]
                        best = part.argmax(axis=0)
                        out[i, cols] = part[best, np.arange(f)]
                        at[i, cols] = starts[i] + best
                else:
                    ends = np.minimum(starts[full] + sizes[full], len(got))
                    edges = np.stack([starts[full], ends], 1).ravel()
                    if edges[-1] == len(got):
                        edges = edges[:-1]
                    out[full, cols] = np.maximum.reduceat(got, edges, axis=0)[::2]
        return (np.maximum(out, 0), at, words, starts, sizes) if places else np.maximum(out, 0)

    def logits(self, texts: list[np.ndarray]) -> np.ndarray:
        return self.features(texts) @ self.out + self.const

    def train(self, texts: list[np.ndarray], labels: np.ndarray, epochs: int = 6, batch: int = 32,
              rate: float = 0.05, seed: int = 5) -> None:
        """Adagrad on the logistic loss, both labels weighing the same in all."""
        self._start_from_log_odds(texts, labels)
        weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
        square = {id(a): np.full(a.shape, 0.1, np.float32) for a in [*self.filters, *self.bias, self.out]}
        table_square = np.full(len(self.table), 0.1, np.float32)
        const_square = 0.1
        f = self.out.size // len(WIDTHS)
        order = np.random.default_rng(seed)
        for _ in range(epochs):
            shuffled = order.permutation(len(texts))
            for lo in range(0, len(texts), batch):
                pick = shuffled[lo:lo + batch]
                some = [texts[i] for i in pick]
                feats, at, words, starts, sizes = self.features(some, places=True)
                z = feats @ self.out + self.const
                dz = ((1 / (1 + np.exp(-z)) - labels[pick]) * weight[pick] / len(pick)).astype(np.float32)
                grads: list[tuple[np.ndarray, np.ndarray]] = [(self.out, feats.T @ dz)]
                dfeat = np.outer(dz, self.out) * (feats > 0)
                dwords: dict[int, np.ndarray] = {}
                for k, w in enumerate(WIDTHS):
                    cols = slice(k * f, (k + 1) * f)
                    grads.append((self.bias[k], dfeat[:, cols].sum(axis=0)))
                    df = np.zeros_like(self.filters[k])
                    for i, c in zip(*np.nonzero(dfeat[:, cols])):
                        g, p = dfeat[i, k * f + c], at[i, k * f + c]
                        for j in range(w):
                            df[j, :, c] += g * words[p + j]
                            if p + j < starts[i] + sizes[i]:
                                word = int(some[i][p + j - starts[i]])
                                dwords[word] = dwords.get(word, 0) + g * self.filters[k][j, :, c]
                    grads.append((self.filters[k], df))
                for a, g in grads:
                    square[id(a)] += g * g
                    a -= rate * g / np.sqrt(square[id(a)])
                gc = float(dz.sum())
                const_square += gc * gc
                self.const -= rate * gc / const_square ** 0.5
                for word, g in dwords.items():
                    for row in rows_of(np.int64(word)):
                        table_square[row] += float(g @ g) / len(g)
                        self.table[row] -= rate * g / table_square[row] ** 0.5

    def _start_from_log_odds(self, texts: list[np.ndarray], labels: np.ndarray) -> None:
        """Half the smoothed log-odds of a row's presence, so that the two rows of a word add up."""
        seen = np.zeros((2, len(self.table)))
        for t, y in zip(texts, labels):
            seen[int(y), np.unique(np.concatenate(rows_of(t)))] += 1
        share = [(seen[y] + 2.0) / (max(1, (labels == y).sum()) + 4.0) for y in (0, 1)]
        base = np.log(2.0 / (max(1, (labels == 1).sum()) + 4.0)) - np.log(2.0 / (max(1, (labels == 0).sum()) + 4.0))
        self.table[:, 0] = 0.5 * (np.log(share[1] / share[0]) - base)
        self.const = -float(np.mean([np.max(self.table[rows_of(t)[0], 0] + self.table[rows_of(t)[1], 0], initial=0)
                                     for t in texts])) * len(WIDTHS)


def best_threshold(z: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    values, at = np.unique(z, return_inverse=True)
    return best_cut(values, values, np.bincount(at, labels * weights, len(values)), np.bincount(at, weights, len(values)))


def best_cut(low: np.ndarray, high: np.ndarray, hits: np.ndarray, weights: np.ndarray) -> float:
    """The margin with the best F1 among the gaps of rising bins, half way between them; a bin can't be cut."""
    if not len(low) or not hits.any():
        return 0.0
    low, high, hits, weights = low[::-1], high[::-1], hits[::-1], weights[::-1]
    f1 = 2 * np.cumsum(hits) / (np.cumsum(weights) + hits.sum())
    k = int(np.argmax(f1))
    return float((low[k] + high[k + 1]) / 2) if k + 1 < len(low) else float(low[k] - 1.0)


def known_labels(labels: DataFrame, doc_id: str, label: str, held_out: int) -> DataFrame:
    """id and y of the labelled documents outside the held-out fold."""
    return (labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & (fold(F.col(doc_id)) != held_out))
            .groupBy(F.col(doc_id).alias("id")).agg(F.max(F.col(label).cast("int")).alias("y")))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int, longest: int, text: str, doc_id: str,
                  label: str, held_out: int) -> list:
    """Up to `sample` rows of each label as (label, id, packed words)."""
    known = known_labels(labels, doc_id, label, held_out)
    mix = F.xxhash64(F.col("id").cast("string"))
    chosen = None
    for y in (0, 1):
        some = known.where(F.col("y") == y).orderBy(mix, "id").limit(sample)
        chosen = some if chosen is None else chosen.unionByName(some)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(
        F.broadcast(chosen), "id")  # at most 2 * sample rows of two numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            got = [words.of(t) for t in as_bytes(b, "text")]
            keep = [k for k, g in enumerate(got) if len(g) <= longest]
            yield pa.RecordBatch.from_arrays(
                [b.column(c).take(pa.array(keep, pa.int64())) for c in ("id", "y")]
                + [pa.array([got[k].tobytes() for k in keep], pa.binary())], names=["id", "y", "words"])

    id_type = docs.schema[doc_id].dataType.simpleString()
    got = map_batches(rows.select("id", "y", "text"), run, f"id {id_type}, y int, words binary").collect()
    return [(r["y"], r["id"], np.frombuffer(r["words"], np.int64))
            for r in sorted(got, key=lambda r: (str(r["id"]), r["words"]))]


def learn(docs: DataFrame, labels: DataFrame, sample: int = 6000, longest: int = 4096, text: str = "text",
          doc_id: str = "doc_id", label: str = "toxic", held_out: int = 0) -> tuple[Network | float, dict]:
    """A network without thresholds and the rows that it has seen, id -> (label, rows); or a constant score where the
    labels do not hold both kinds."""
    rows = training_rows(docs, labels, sample, longest, text, doc_id, label, held_out)
    y = np.array([r[0] for r in rows], np.int64)
    if not len(y) or y.min() == y.max():
        return (float(y.sum()) + 0.5) / (len(y) + 1.0), {}
    number = {i: k for k, i in enumerate(dict.fromkeys(r[1] for r in rows))}
    seen = np.array([number[r[1]] % 4 != 3 for r in rows])  # the others are for the thresholds
    net = Network()
    net.train([r[2] for r, s in zip(rows, seen) if s], y[seen])
    counts = Counter(r[1] for r, s in zip(rows, seen) if s)
    return net, {r[1]: (int(r[0]), counts[r[1]]) for r, s in zip(rows, seen) if s}


def thresholds(rows: DataFrame, labels: DataFrame, seen: dict, longest: int = 4096, doc_id: str = "doc_id",
               label: str = "toxic", held_out: int = 0) -> np.ndarray:
    """Each language's threshold from `rows` (doc_id, margin, language, n_words): the margin with the best F1 over all
    labelled rows that the fit has not seen; a language with fewer than LEAST_TOXIC toxic rows takes that of all."""
    used = rows.sparkSession.createDataFrame([(i,) for i in seen], f"id {rows.schema[doc_id].dataType.simpleString()}")
    known = known_labels(labels, doc_id, label, held_out).join(F.broadcast(used), "id", "left_anti")  # 2 * sample ids
    place = F.floor(F.least(F.greatest(F.col("margin"), F.lit(-RANGE)), F.lit(RANGE)) * BINS)
    bins = rows.join(known, rows[doc_id] == known["id"]).groupBy(
        "language", "y", (F.col("n_words") > longest).alias("long"), place.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.min("margin").alias("low"), F.max("margin").alias("high")).toPandas()
    weight = np.ones(len(bins))
    for y in (0, 1):  # the fit has seen short rows only
        short = ((bins["y"] == y) & ~bins["long"].astype(bool)).to_numpy(bool)
        left = int(bins["n"][short].sum())
        weight[short] += sum(n for label, n in seen.values() if label == y) / max(1, left)
    bins["weight"] = bins["n"] * weight
    bins["hits"] = bins["weight"] * bins["y"]

    def cut(some) -> float:
        got = some.groupby("bin").agg({"low": "min", "high": "max", "hits": "sum", "weight": "sum"}).sort_index()
        return best_cut(*(got[c].to_numpy(float) for c in ("low", "high", "hits", "weight")))

    out = np.full(len(LANGUAGES), cut(bins))
    for g, own in bins.groupby("language"):
        if (own["n"] * own["y"]).sum() >= LEAST_TOXIC:
            out[int(g)] = cut(own)
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = 6000, longest: int = 4096, text: str = "text",
        doc_id: str = "doc_id", label: str = "toxic", held_out: int = 0) -> Network | float:
    """A trained network with its thresholds, or a constant score where the labels do not hold both kinds."""
    net, seen = learn(docs, labels, sample, longest, text, doc_id, label, held_out)
    if not isinstance(net, float):
        net.thresholds = thresholds(margins(docs, net, [doc_id], text), labels, seen, longest, doc_id, label, held_out)
    return net


def score_texts(net: Network | float, texts: list[bytes], words: Words, most: int = 200_000) -> np.ndarray:
    """Scores of whole texts."""
    if isinstance(net, float):
        return np.full(len(texts), net)
    margin, langs, _ = measure(net, texts, words, most)
    return 1 / (1 + np.exp(-np.clip(np.round(margin - net.thresholds[langs], 9), -50, 50)))


def measure(net: Network, texts: list[bytes], words: Words,
            most: int = 200_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Margin, language and words of whole texts; a text of more than `most` words is pooled over overlapping stretches."""
    out, group, held, langs, sizes = [], [], 0, [], []

    def flush() -> None:
        nonlocal held
        if group:
            out.append(net.logits(group))
            group.clear()
            held = 0

    for t in texts:
        packed = words.of(t)
        langs.append(language_of(packed))
        sizes.append(len(packed))
        if held + len(packed) > most:
            flush()
        if len(packed) > most:
            parts = [net.features([packed[k:k + most + PAD]]) for k in range(0, len(packed), most)]
            out.append(np.max(parts, axis=0) @ net.out + net.const)
        else:
            group.append(packed)
            held += len(packed)
    flush()
    margin = np.concatenate(out) if out else np.empty(0)
    return margin, np.array(langs, np.int64), np.array(sizes, np.int64)


def margins(docs: DataFrame, net: Network, keep: list[str], text: str = "text") -> DataFrame:
    """`keep` columns of every row with its margin, language and n_words."""
    sent = docs.sparkSession.sparkContext.broadcast(net)  # the table's size is fixed by BITS
    read = text if text in keep else "__text"  # a text that is kept anyway is not sent twice
    narrow = docs.select(*keep) if text in keep else docs.select(*keep, F.col(text).alias(read))
    kept = [narrow.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in (s for batch in batches for s in slices(batch, read, 2_000_000)):
            got = measure(sent.value, as_bytes(b, read), words)
            yield pa.RecordBatch.from_arrays([b.column(f.name) for f in kept] + [pa.array(g) for g in got],
                                             names=[*(f.name for f in kept), "margin", "language", "n_words"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept]
                       + ["margin double, language long, n_words long"])
    return map_batches(narrow, run, schema)


def score_of(net: Network) -> Column:
    """The score from the columns margin and language."""
    own = F.element_at(F.array(*[F.lit(float(t)) for t in net.thresholds]), (F.col("language") + 1).cast("int"))
    over = F.least(F.greatest(F.round(F.col("margin") - own, 9), F.lit(-50.0)), F.lit(50.0))
    return 1 / (1 + F.exp(-over))


def score(docs: DataFrame, net: Network | float, keep: list[str], text: str = "text") -> DataFrame:
    """`keep` columns of every row with its score."""
    if isinstance(net, float):
        return docs.select(*keep, F.lit(net).alias("score"))
    return margins(docs.select(*dict.fromkeys([*keep, text])), net, keep, text).select(*keep, score_of(net).alias("score"))


def judge(docs: DataFrame, labels: DataFrame, keep: list[str], text: str = "text", doc_id: str = "doc_id",
          sample: int = 6000, longest: int = 4096, label: str = "toxic", held_out: int = 0) -> DataFrame:
    """`keep` columns (without the text) of every row with its score: fitted, and each text's margin found once."""
    net, seen = learn(docs, labels, sample, longest, text, doc_id, label, held_out)
    if isinstance(net, float):
        return score(docs, net, keep, text)
    rows = freeze(margins(docs.select(*dict.fromkeys([*keep, doc_id, text])), net, list(dict.fromkeys([*keep, doc_id])), text),
                  "margins")
    net.thresholds = thresholds(rows, labels, seen, longest, doc_id, label, held_out)
    return rows.select(*keep, score_of(net).alias("score"))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    return judge(docs, labels, [doc_id], text, doc_id, **options).select(
        doc_id, (fold(F.col(doc_id)) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
