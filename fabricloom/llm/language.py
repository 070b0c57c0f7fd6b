"""Language identification by a linear-chain conditional random field over the words of a text.

A word's features are its affixes, its inner n-grams and the language whose lexicon holds it; transitions between the
languages of neighbouring words are learned too, from pieces of different texts laid side by side. Forward-backward over a whole text
gives each word a distribution over languages, so a text that switches language falls into spans.

Counts of words cover all labelled documents; the weights are fitted on a sample of them, in rounds: each shard of the
sample goes through its sequences, and the shards' weights are averaged (iterative parameter mixing).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .anchors import A, B, U, _tables, mix
from .common import Scratch, aside, short_batches, slices

UNKNOWN = "und"  # fixed value
BITS = 16
AFFIX, GRAMS = 4, (2, 3)
#: Words of a stretch of a text that is worked through at once with others.
STRETCH = 32
#: Entries at most (words times languages) of a worker's table of words; when full it starts anew.
TABLE = 4_000_000


@dataclass(frozen=True)
class Fit:
    """What the classifier is fitted on: of each language the expected number of documents sampled, from each of these so
    many pieces of so many words, and of its lexicon the most frequent words. The bounds don't grow with the corpus."""

    documents: int = 2_000
    pieces: int = 4
    words: int = 12
    lexicon: int = 4_000
    least_count: int = 5
    share: float = 0.8
    shards: int = 8
    rounds: int = 5


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (2 ** BITS + languages, languages)
    moves: np.ndarray  # (languages, languages): from a word's language to the next one's
    first: np.ndarray  # (languages,)
    lexicon: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted hashes of words
    listed: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # the language of each
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


@lru_cache(1)
def _letters():
    """Which code points are letters, and the small letter of each."""
    letter, small = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            letter[c] = True
            y = x.lower()
            if len(y) == 1:
                small[c] = ord(y)
    return letter, small


def words_of(texts: list[str]):
    """Code points of consecutive texts, letters made small, and where words (runs of letters) begin, stop, and in which
    text and where in it they stand."""
    letter, small = _letters()
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    solid = np.concatenate([letter[points], [False]])
    edge = np.zeros(len(points) + 1, bool)
    edge[ends] = edge[0] = True
    before = np.concatenate([[False], solid[:-1]])
    begins, stops = np.flatnonzero(solid & (~before | edge)), np.flatnonzero(before & (~solid | edge))
    whose = np.searchsorted(ends, begins, side="right")
    return small[points], begins, stops, whose, begins - np.concatenate([[0], ends])[whose]


class Hashes:
    """Hashes of stretches of code points modulo 2**64."""

    def __init__(self, points: np.ndarray):
        _, self.up, self.down = _tables(1 << max(16, int(len(points)).bit_length()), 0)
        self.total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(mix((points.astype(np.uint64) + U(1)) * A) * self.up[: len(points)], out=self.total[1:])

    def of(self, begins: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return (self.total[stops] - self.total[begins]) * self.down[begins]


def features(hashes: Hashes, begins: np.ndarray, stops: np.ndarray):
    """Numbers of the affix and n-gram features of words, and the word of each, in any order."""
    sizes, rows = stops - begins, np.arange(len(begins))
    found, whose = [], []

    def add(a, b, words, kind):
        found.append(mix(hashes.of(a, b) + U(kind * int(B) % (1 << 64))) >> U(64 - BITS))
        whose.append(words)

    for n in range(1, AFFIX + 1):
        some = rows[sizes >= n]
        add(begins[some], begins[some] + n, some, n)
        add(stops[some] - n, stops[some], some, 16 + n)
    for n in GRAMS:
        many = np.maximum(sizes - n + 1, 0)
        words = np.repeat(rows, many)
        at = begins[words] + np.arange(len(words)) - np.repeat(np.cumsum(many) - many, many)
        add(at, at + n, words, 32 + n)
    return np.concatenate(found).astype(np.int64), np.concatenate(whose)


def listed(model: Model, hashes: np.ndarray) -> np.ndarray:
    """The language whose lexicon holds each word, else -1."""
    if not len(model.lexicon):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(model.lexicon, hashes), len(model.lexicon) - 1)
    return np.where(model.lexicon[at] == hashes, model.listed[at], -1)


class Scorer:
    """Scores of words for each language, kept in a bounded table of words that were met before."""

    def __init__(self, model: Model):
        self.model = model
        self.hashes, self.scores = np.zeros(0, np.uint64), np.zeros((0, len(model.languages)), np.float32)

    def of(self, points, begins, stops) -> np.ndarray:
        rolled = Hashes(points)
        words = mix(rolled.of(begins, stops))
        known, example, place = np.unique(words, return_index=True, return_inverse=True)
        count = len(self.model.languages)
        if (len(self.hashes) + len(known)) * count > TABLE:
            self.hashes, self.scores = self.hashes[:0], self.scores[:0]
        at = np.searchsorted(self.hashes, known)
        missing = np.ones(len(known), bool)
        inside = at < len(self.hashes)
        missing[inside] = self.hashes[at[inside]] != known[inside]
        if missing.any():
            some = example[missing]
            ids, whose = features(rolled, begins[some], stops[some])
            weights = self.model.weights
            scores = np.column_stack([np.bincount(whose, weights[ids, k], len(some)) for k in range(count)])
            in_list = listed(self.model, known[missing])
            scores[in_list >= 0] += weights[(1 << BITS) + in_list[in_list >= 0]]
            self.hashes = np.insert(self.hashes, at[missing], known[missing])
            self.scores = np.insert(self.scores, at[missing], scores.astype(np.float32), axis=0)
            at = np.searchsorted(self.hashes, known)
        return self.scores[at[place]]


def marginals(scores: np.ndarray, lengths: np.ndarray, model: Model) -> np.ndarray:
    """The distribution over languages of each word of consecutive texts with `lengths` words (each over 0).

    Texts are cut into stretches. The product of a stretch's factors takes what comes in before it to what goes on after it, so
    chains over stretches give each its exact borders, and then all stretches are gone through side by side."""
    count = len(model.languages)
    move, first = np.exp(model.moves), np.exp(model.first - model.first.max())
    x = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(float)
    per_text = -(-lengths // STRETCH)
    text = np.repeat(np.arange(len(lengths)), per_text)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    begin = (np.cumsum(lengths) - lengths)[text] + nth * STRETCH
    size = np.minimum(STRETCH, lengths[text] - nth * STRETCH)
    by_size = np.argsort(-size, kind="stable")
    begin, size, nth, text = begin[by_size], size[by_size], nth[by_size], text[by_size]
    active = np.searchsorted(-size, -np.arange(STRETCH), side="left")  # stretches with a word t: size > t
    place = np.empty(len(by_size), np.int64)
    place[by_size] = np.arange(len(by_size))  # of the stretches in order of the texts
    head = np.cumsum(per_text) - per_text

    entry, leave = np.ones((len(size), count)), np.ones((len(size), count))
    if per_text.max(initial=0) > 1:
        through = np.where((nth == 0)[:, None, None], np.eye(count), move) * x[begin][:, None, :]
        for t in range(1, STRETCH):
            k = active[t]
            part = (through[:k].reshape(-1, count) @ move).reshape(k, count, count) * x[begin[:k] + t][:, None, :]
            through[:k] = part / part.max(axis=(1, 2), keepdims=True) if t % 4 == 0 else part
        through /= through.max(axis=(1, 2), keepdims=True)
        long = np.argsort(-per_text, kind="stable")
        on, back = np.tile(first, (len(long), 1)), np.ones((len(long), count))
        more = np.searchsorted(-per_text[long], -np.arange(per_text.max() + 1), side="left")
        for s in range(1, per_text.max()):
            k = more[s]
            on[:k] = np.einsum("ij,ijk->ik", on[:k], through[place[head[long[:k]] + s - 1]])
            on[:k] /= on[:k].max(axis=1, keepdims=True)
            entry[place[head[long[:k]] + s]] = on[:k]
        for s in range(per_text.max() - 1, 0, -1):
            k = more[s]
            back[:k] = np.einsum("ijk,ik->ij", through[place[head[long[:k]] + s]], back[:k])
            back[:k] /= back[:k].max(axis=1, keepdims=True)
            leave[place[head[long[:k]] + s - 1]] = back[:k]
    ahead = np.zeros((len(x), count))
    now = np.where((nth == 0)[:, None], first, entry @ move) * x[begin]
    now /= now.max(axis=1, keepdims=True)
    ahead[begin] = now
    for t in range(1, STRETCH):
        k = active[t]
        if not k:
            break
        now = (now[:k] @ move) * x[begin[:k] + t]
        now /= now.max(axis=1, keepdims=True)
        ahead[begin[:k] + t] = now
    out = np.empty_like(ahead)
    after = leave.copy()
    for t in range(STRETCH - 1, -1, -1):
        k = active[t]
        if not k:
            continue
        p = ahead[begin[:k] + t] * after[:k]
        out[begin[:k] + t] = p / p.sum(axis=1, keepdims=True)
        back = (x[begin[:k] + t] * after[:k]) @ move.T
        after[:k] = back / back.max(axis=1, keepdims=True)
    return out


def _epoch(model: Model, points, begins, stops, labels, lengths, seed: int) -> None:
    """Goes through sequences of words once, in small batches, by the gradient of their log-likelihood (AdaGrad). The
    lexicon is hidden from half of the words, or what it lists would never be learned from affixes."""
    rng, count = np.random.default_rng(seed), len(model.languages)
    rolled = Hashes(points)
    ids, whose = features(rolled, begins, stops)
    order = np.argsort(whose, kind="stable")
    ids, per_word = ids[order], np.bincount(whose, minlength=len(begins))
    at = np.cumsum(per_word) - per_word
    in_list = listed(model, mix(rolled.of(begins, stops)))
    in_list[rng.random(len(in_list)) < 0.5] = -1
    starts = np.cumsum(lengths) - lengths
    grown = [np.full_like(p, 1e-2) for p in (model.weights, model.moves, model.first)]
    for some in np.array_split(rng.permutation(len(lengths)), max(1, len(lengths) // 64)):
        sizes = lengths[some]
        words = np.repeat(starts[some] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        many = per_word[words]
        mine = np.repeat(at[words] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        f, of = ids[mine], np.repeat(np.arange(len(words)), many)
        extra = np.flatnonzero(in_list[words] >= 0)
        f, of = np.concatenate([f, (1 << BITS) + in_list[words][extra]]), np.concatenate([of, extra])
        scores = np.column_stack([np.bincount(of, model.weights[f, k], len(words)) for k in range(count)])
        p = marginals(scores, sizes, model)
        y = labels[words]
        gap = -p
        gap[np.arange(len(y)), y] += 1
        steps = [np.column_stack([np.bincount(f, gap[of, k], len(model.weights)) for k in range(count)]) - 1e-3 * model.weights]
        last = np.zeros(len(words), bool)
        last[np.cumsum(sizes) - 1] = True
        left = np.flatnonzero(~last)
        pair = _pairs(scores, p, left, sizes, model)
        moved = np.zeros((count, count))
        np.add.at(moved, (y[left], y[left + 1]), 1)
        steps.append(moved - pair - 1e-3 * model.moves)
        opened = np.cumsum(sizes) - sizes
        steps.append(gap[opened].sum(axis=0))
        for weight, total, step in zip((model.weights, model.moves, model.first), grown, steps):
            step /= len(some)
            total += step**2
            weight += (0.2 * step / np.sqrt(total)).astype(weight.dtype)


def _pairs(scores, p, left, sizes, model: Model) -> np.ndarray:
    """The expected number of moves between each two languages: by the chain rule from the marginals of a word and what the
    words from the next one on say about it."""
    count, move = len(model.languages), np.exp(model.moves)
    x = np.exp(scores - scores.max(axis=1, keepdims=True))
    follow = np.ones((len(scores), count))
    ends = np.cumsum(sizes) - 1
    for t in range(1, int(sizes.max(initial=1))):
        at = (ends - t)[sizes > t]
        back = (x[at + 1] * follow[at + 1]) @ move.T
        follow[at] = back / back.max(axis=1, keepdims=True)
    # given a word's language, the next one's distribution doesn't depend on what came before
    given = move[None] * (x[left + 1] * follow[left + 1])[:, None, :]
    given /= np.maximum(given.sum(axis=2, keepdims=True), 1e-300)
    return (p[left][:, :, None] * given).sum(axis=0)


def _count_words(batches):
    """Counts of words by language, added up within a batch."""
    import pyarrow as pa

    for batch in batches:
        for part in slices(batch, "text"):
            points, begins, stops, whose, _ = words_of(part.column(1).to_pylist())
            words = mix(Hashes(points).of(begins, stops)).astype(np.int64)
            label = part.column(0).to_numpy(zero_copy_only=False)[whose]
            order = np.lexsort([label, words])
            words, label = words[order], label[order]
            new = np.ones(len(words), bool)
            new[1:] = (words[1:] != words[:-1]) | (label[1:] != label[:-1])
            first = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays([pa.array(words[first]), pa.array(label[first], pa.int32()), pa.array(np.diff(np.append(first, len(words))), pa.int64())], ["word", "language", "n"])


def _pieces(fit: Fit):
    """Pieces of the sampled texts, spread over each whole text."""

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column(1).to_pylist()
                points, begins, stops, whose, _ = words_of(texts)
                n = np.bincount(whose, minlength=len(texts))
                head = np.cumsum(n) - n
                rows, found = [], []
                for r in range(len(texts)):
                    pieces = min(fit.pieces, int(n[r]) // fit.words) or int(n[r] > 0)
                    for k in range(pieces):
                        a = head[r] + (k * (int(n[r]) - fit.words) // max(1, pieces - 1) if n[r] > fit.words else 0)
                        b = min(a + fit.words, head[r] + n[r])
                        words = ["".join(map(chr, points[i:j])) for i, j in zip(begins[a:b], stops[a:b])]
                        rows.append(r)
                        found.append(" ".join(words))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.string())], ["language", "piece"])

    return cut


def sequences(pieces: list[str], labels: np.ndarray, per: int = 3):
    """Words of pieces laid side by side, once with neighbours of one language, once in the order of their hashes, so that
    languages switch: code points, begins, stops, the language of each word, and the words of each sequence."""
    points, begins, stops, whose, _ = words_of(pieces)
    n = np.bincount(whose, minlength=len(pieces))
    head = np.cumsum(n) - n
    mark = np.array([hash_of(p) for p in pieces], np.uint64)
    orders = [np.lexsort([mark, labels]), np.argsort(mark, kind="stable")]
    order = np.concatenate(orders)
    many = n[order]
    words = np.repeat(head[order] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    lengths = np.add.reduceat(many, np.arange(0, len(many), per)) if len(many) else many
    return points, begins[words], stops[words], labels[np.repeat(order, many)], lengths[lengths > 0]


def hash_of(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def train(docs: DataFrame, text: str, lang: str, fit: Fit = Fit()) -> Model:
    """A model from labelled documents. Rows with a null text or language teach nothing. The number of languages is taken to
    be small (their counts come to the driver)."""
    short_batches(docs.sparkSession)
    staged = Scratch()
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(counts)
    count = len(languages)
    model = Model(languages, np.zeros(((1 << BITS) + count, count), np.float32), np.zeros((count, count)), np.zeros(count))
    if not languages:
        return model
    number = F.create_map(*[F.lit(v) for k, name in enumerate(languages) for v in (name, k)])[F.col("lang")].cast("int")
    rows = rows.select(number.alias("language"), "text")
    found = rows.mapInArrow(_count_words, "word bigint, language int, n bigint").groupBy("word", "language").agg(F.sum("n").alias("n"))
    best = found.groupBy("word").agg(F.max(F.struct("n", "language")).alias("best"), F.sum("n").alias("all")).select("word", F.col("best.language").alias("language"), F.col("best.n").alias("n"), "all")
    best = best.where((F.col("n") >= fit.least_count) & (F.col("n") >= fit.share * F.col("all")))
    best = best.withColumn("part", F.pmod("word", F.lit(64)))
    for groups in (["language", "part"], ["language"]):  # the first of each part, so that no task ranks a language's words
        nth = F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc("n"), "word"))
        best = best.withColumn("nth", nth).where(F.col("nth") <= fit.lexicon)
    top = best.select("word", "language").collect()
    words = np.array([r["word"] for r in top], np.int64).astype(np.uint64)
    order = np.argsort(words)
    model.lexicon, model.listed = words[order], np.array([r["language"] for r in top], np.int64)[order]

    share = F.create_map(*[F.lit(v) for k, name in enumerate(languages) for v in (k, min(1.0, fit.documents / counts[name]))])[F.col("language")]
    drawn = rows.where(F.pmod(F.xxhash64("text", F.lit(17)), F.lit(1 << 30)) < share * (1 << 30))
    pieces = drawn.mapInArrow(_pieces(fit), "language int, piece string").withColumn("shard", F.pmod(F.xxhash64("piece", F.lit(29)), F.lit(fit.shards)).cast("int"))
    pieces = staged(pieces, "language-pieces")
    for turn in range(fit.rounds):
        learned = pieces.groupBy("shard").applyInArrow(_learn(model, turn), "n bigint, weights binary, moves binary, first binary").collect()
        total = sum(r["n"] for r in learned)
        for name in ("weights", "moves", "first"):
            old = getattr(model, name)
            parts = [np.frombuffer(r[name], old.dtype).reshape(old.shape) * (r["n"] / total) for r in learned]
            if parts:
                setattr(model, name, np.sum(parts, axis=0).astype(old.dtype))
    staged.drop()
    return model


def _learn(model: Model, turn: int):
    """One shard's turn from the common weights; bounded by Fit, which bounds the sample."""

    def learn(table):
        import pyarrow as pa

        own = Model(model.languages, model.weights.copy(), model.moves.copy(), model.first.copy(), model.lexicon, model.listed)
        labels = np.asarray(table["language"].to_numpy(), np.int64)
        points, begins, stops, y, lengths = sequences(table["piece"].to_pylist(), labels)
        if len(lengths):
            for k in range(2):
                _epoch(own, points, begins, stops, y, lengths, 2 * turn + k)
        return pa.table({"n": [max(1, len(lengths))], "weights": [own.weights.tobytes()], "moves": [own.moves.tobytes()], "first": [own.first.tobytes()]})

    return learn


_scorers: dict[str, Scorer] = {}


def identify(docs: DataFrame, model: Model, text: str = "text", with_text: bool = True) -> DataFrame:
    """Adds lang_pred, score and spans to documents.

    lang_pred is the language that the words of the whole text are most in by their marginals, score its mean marginal; spans are
    the runs of words most probably in one language: start and stop in code points, lang, p (mean marginal of that language).
    A null text, or one without a letter, is UNKNOWN with score 0 and no spans, and so are all without a learned language. Equal
    marginals go to the language that sorts first. Columns of these names are replaced. with_text: whether the text is handed back.
    """
    short_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "spans")
    plain, _ = aside(docs, text)
    kept = [f for f in plain.schema if with_text or f.name != text]
    names = [f.name for f in kept]
    spans = "array<struct<start: bigint, stop: bigint, lang: string, p: double>>"

    def predict(batches):
        import pyarrow as pa

        scorer = _scorers.get(model.key)
        if scorer is None:
            _scorers.clear()
            scorer = _scorers[model.key] = Scorer(model)
        languages = np.array(model.languages, object)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("lang", pa.string()), ("p", pa.float64())]))
        for batch in batches:
            for part in slices(batch, text):
                column = part.column(part.schema.get_field_index(text))
                texts = [t or "" for t in column.to_pylist()]
                points, begins, stops, whose, start = words_of(texts)
                n = np.bincount(whose, minlength=len(texts))
                said, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
                offsets, parts = np.zeros(len(texts) + 1, np.int32), [[], [], [], []]
                if len(begins) and len(languages):
                    p = marginals(scorer.of(points, begins, stops), n[n > 0], model)
                    some = np.flatnonzero(n)
                    head = (np.cumsum(n) - n)[some]
                    mass = np.add.reduceat(p, head, axis=0) / n[some][:, None]
                    best = mass.argmax(axis=1)
                    said[some], score[some] = languages[best], np.minimum(1.0, mass[np.arange(len(some)), best])
                    label = p.argmax(axis=1)
                    new = np.ones(len(label), bool)
                    new[1:] = (label[1:] != label[:-1]) | (whose[1:] != whose[:-1])
                    first = np.flatnonzero(new)
                    last = np.append(first[1:], len(label)) - 1
                    width = stops - begins
                    parts = [start[first], start[last] + width[last], languages[label[first]], np.add.reduceat(p[np.arange(len(label)), label], first) / (last - first + 1)]
                    offsets = np.searchsorted(whose[first], np.arange(len(texts) + 1)).astype(np.int32)
                fields = [pa.array(x, t.type) for x, t in zip(parts, kind.value_type)]
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, fields=list(kind.value_type)))
                own = [part.column(part.schema.get_field_index(x)) for x in names]
                yield pa.RecordBatch.from_arrays([*own, pa.array(said, pa.string()), pa.array(score), lists], [*names, "_said", "_score", "_spans"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", _said string, _score double, _spans {spans}"
    out = plain.mapInArrow(predict, schema)
    named = [F.col(n).alias(c) for n, c in zip(plain.columns, docs.columns) if n in names]
    return out.select(*named, F.col("_said").alias("lang_pred"), F.col("_score").alias("score"), F.col("_spans").alias("spans"))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning; a null doc_id isn't held out, but teaches nothing either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op12_crf_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))), "text", "lang")
    return identify(docs.select("doc_id", "text"), model, with_text=False).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
