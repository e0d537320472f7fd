"""Toxicity by a convolutional text classifier, trained in numpy.

Words are hashed; the hashes seen in training have embeddings. Filters of several
widths run over the whole text, the largest response of each is pooled, and a
logistic unit reads the pools. A score is a function of the text alone: the
language by which its threshold is chosen is told from the text's own words.

Training reads a bounded sample of labelled rows (SAMPLE of each class, at most
TRAIN_WORDS words each) into the driver. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewright.llm.common import col, without

SAMPLE = 2_500  # labelled rows of each class that training reads at most
TRAIN_WORDS = 20_000  # longer texts are scored, but not learned from
BUCKETS = 1 << 22
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 6  # of each width
EPOCHS = 6
BATCH = 32
SEED = 7
#: Words by which the language of a text is told.
LANGUAGE_WORDS = {
    "en": "the of and to in is that it for with was".split(),
    "fr": "le les des et est dans pour qui que une".split(),
    "de": "der die das und von den mit nicht ist ein".split(),
    "es": "el los las del una que por con se y".split(),
}


class Reader:
    """Hashes of a text's words, through a bounded table of words met before."""

    def __init__(self, limit: int = 100_000):
        self.table: dict[str, int] = {}
        self.limit = limit

    def __call__(self, text: str) -> np.ndarray:
        import re
        import zlib

        words, table = re.findall(r"\w+", text.lower()), self.table
        if len(table) > self.limit:
            table.clear()
        for w in set(words):
            if w not in table:
                table[w] = zlib.crc32(w.encode()) % BUCKETS
        return np.fromiter(map(table.__getitem__, words), dtype=np.int32, count=len(words))


@dataclass
class Model:
    """known: sorted hashes with an embedding; row 0 of `embed` is for all others."""

    known: np.ndarray
    embed: np.ndarray
    filters: list[np.ndarray]  # of each width: width x DIM x FILTERS
    bias: np.ndarray
    out: np.ndarray
    base: float
    language_rows: dict[str, list[int]] = field(default_factory=dict)
    threshold: dict[str, float] = field(default_factory=dict)

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(len(hashes), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, at + 1, 0)

    def tables(self) -> list[list[np.ndarray]]:
        """What each word adds to each filter at each of its places."""
        return [[(self.embed @ f[j]).astype(np.float32) for j in range(len(f))] for f in self.filters]


def _laid_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts one after another, each at least a word long and followed by empty words."""
    gap = max(WIDTHS) - 1
    sizes = np.array([max(1, len(t)) for t in texts])
    starts = np.concatenate(([0], np.cumsum(sizes + gap)[:-1]))
    whole = np.zeros(int(starts[-1] + sizes[-1] + gap), dtype=np.int64)
    for s, t in zip(starts, texts):
        whole[s: s + len(t)] = t
    return whole, starts, starts + sizes


def _responses(tables: list[list[np.ndarray]], bias: np.ndarray, whole: np.ndarray) -> Iterator[np.ndarray]:
    n = len(whole) - max(WIDTHS) + 1
    for w, places in enumerate(tables):
        made = places[0][whole[:n]]
        for j in range(1, len(places)):
            made += places[j][whole[j: n + j]]
        yield made + bias[w * FILTERS: (w + 1) * FILTERS].astype(np.float32)


def _trained_responses(model: Model, whole: np.ndarray) -> list[np.ndarray]:
    """As _responses, with embeddings that change: one product for the batch's words."""
    every = np.concatenate([f[j] for f in model.filters for j in range(len(f))], axis=1)
    parts = model.embed[whole] @ every
    n, at, out = len(whole) - max(WIDTHS) + 1, 0, []
    for w, width in enumerate(WIDTHS):
        made = np.zeros((n, FILTERS)) + model.bias[w * FILTERS: (w + 1) * FILTERS]
        for j in range(width):
            made += parts[j: n + j, at: at + FILTERS]
            at += FILTERS
        out.append(made)
    return out


def logits(model: Model, tables: list[list[np.ndarray]], texts: list[np.ndarray]) -> np.ndarray:
    """texts: rows of embeddings."""
    whole, starts, stops = _laid_out(texts)
    edges = np.stack([starts, stops], axis=1).ravel()[:-1] if len(starts) > 1 else starts
    pools = []
    for made in _responses(tables, model.bias, whole):
        top = np.maximum.reduceat(made, edges, axis=0)
        pools.append(top[::2] if len(starts) > 1 else made[starts[0]: stops[0]].max(axis=0)[None])
    return np.maximum(np.concatenate(pools, axis=1), 0) @ model.out + model.base


def _first_embeddings(texts: list[np.ndarray], labels: np.ndarray, rng) -> tuple[np.ndarray, np.ndarray]:
    """Known hashes (in two texts or more). The first dimension starts as how far a
    word's share of toxic texts is from its share of the others, in deviations."""
    seen = [np.unique(t) for t in texts]
    pos = np.zeros(BUCKETS, dtype=np.int32)
    every = np.zeros(BUCKETS, dtype=np.int32)
    for s, y in zip(seen, labels):
        every[s] += 1
        if y:
            pos[s] += 1
    known = np.flatnonzero(every >= 2)
    p, n = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
    share = every[known] / (p + n)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / p + 1 / n))
    z = (pos[known] / p - (every[known] - pos[known]) / n) / spread
    embed = rng.normal(0, 0.02, (len(known) + 1, DIM))
    embed[0] = 0
    embed[1:, 0] = np.clip(z / 5, -2, 2)
    return known, embed


def train(texts: list[np.ndarray], labels: np.ndarray) -> Model:
    """Fit on texts as word hashes. One class only, or none: a constant model."""
    rng = np.random.default_rng(SEED)
    width = len(WIDTHS) * FILTERS
    labels = np.asarray(labels, dtype=np.float64)
    if not len(texts) or labels.min() == labels.max():
        level = float(labels[0]) if len(texts) else 0.0
        empty = [np.zeros((w, DIM, FILTERS)) for w in WIDTHS]
        return Model(np.zeros(0, np.int64), np.zeros((1, DIM)), empty, np.zeros(width), np.zeros(width), 6.0 * (2 * level - 1), threshold={"": 0.0})
    held = rng.random(len(texts)) < (0.25 if len(texts) >= 1000 else 0.0)
    fit = np.flatnonzero(~held)
    known, embed = _first_embeddings([texts[i] for i in fit], labels[fit], rng)
    filters = [rng.normal(0, 0.1, (w, DIM, FILTERS)) for w in WIDTHS]
    for f in filters:
        f[:, 0, :] += 0.8
    model = Model(known, embed, filters, np.full(width, -0.1), np.full(width, 0.2), -2.0)
    rows = [model.rows(t) for t in texts]
    state: dict[str, np.ndarray] = {}

    def step(name: str, value: np.ndarray, grad: np.ndarray, rate: float = 0.05, at=slice(None)) -> None:
        seen = state.setdefault(name, np.full(value.shape, 0.1))
        seen[at] += grad * grad
        value[at] -= rate * grad / np.sqrt(seen[at])

    base = np.array([model.base])
    weight = np.where(labels > 0, np.clip((labels[fit] == 0).sum() / max(1, labels[fit].sum()), 1, 5), 1.0)
    for _ in range(EPOCHS):
        order = rng.permutation(fit)
        for a in range(0, len(order), BATCH):
            batch = order[a: a + BATCH]
            whole, starts, stops = _laid_out([rows[i] for i in batch])
            made = _trained_responses(model, whole)
            at = np.stack([np.concatenate([s + m[s:e].argmax(axis=0) for m in made]) for s, e in zip(starts, stops)])
            pooled = np.stack([np.concatenate([m[s:e].max(axis=0) for m in made]) for s, e in zip(starts, stops)])
            hidden = np.maximum(pooled, 0)
            p = 1 / (1 + np.exp(-(hidden @ model.out + base[0])))
            wrong = (p - labels[batch]) * weight[batch] / len(batch)
            back = np.outer(wrong, model.out) * (pooled > 0)
            step("out", model.out, hidden.T @ wrong + 1e-4 * model.out)
            step("base", base, np.array([wrong.sum()]))
            step("bias", model.bias, back.sum(axis=0))
            moved = np.zeros((0,), np.int64), np.zeros((0, DIM))
            for w, f in enumerate(model.filters):
                own = slice(w * FILTERS, (w + 1) * FILTERS)
                grad = np.zeros_like(f)
                for j in range(len(f)):
                    words = whole[at[:, own] + j]  # texts x filters
                    g = back[:, own]
                    grad[j] = np.einsum("bfd,bf->df", model.embed[words], g)
                    add = g[:, :, None] * f[j].T[None]
                    moved = np.concatenate((moved[0], words.ravel())), np.concatenate((moved[1], add.reshape(-1, DIM)))
                step(f"filter{w}", f, grad + 1e-4 * f)
            there, inverse = np.unique(moved[0], return_inverse=True)
            grad = np.zeros((len(there), DIM))
            np.add.at(grad, inverse, moved[1])
            grad[there == 0] = 0
            step("embed", model.embed, grad, 0.02, there)
            model.embed[0] = 0
    model.base = float(base[0])
    import zlib

    for language, words in LANGUAGE_WORDS.items():
        model.language_rows[language] = [zlib.crc32(w.encode()) % BUCKETS for w in words]
    calibrate(model, [texts[i] for i in np.flatnonzero(held)] or texts, labels[held] if held.any() else labels)
    return model


def language_of(model: Model, hashes: np.ndarray) -> str:
    counts = {name: int(np.isin(hashes, rows).sum()) for name, rows in model.language_rows.items()}
    best = max(counts, key=lambda n: (counts[n], n), default="")
    return best if counts.get(best) else ""


def best_threshold(values: np.ndarray, labels: np.ndarray) -> float:
    """The logit that splits with the fewest errors, in the middle of its widest gap."""
    order = np.argsort(values, kind="stable")
    v, y = values[order], labels[order]
    errors = np.concatenate(([0], np.cumsum(y))) + np.concatenate((np.cumsum((1 - y)[::-1])[::-1], [0]))
    gaps = np.concatenate(([1.0], np.diff(v), [1.0]))
    errors = np.where(gaps > 0, errors, np.inf)
    i = max(np.flatnonzero(errors == errors.min()), key=lambda k: gaps[k])
    if i == 0:
        return float(v[0] - 0.5)
    return float(v[-1] + 0.5) if i == len(v) else float((v[i - 1] + v[i]) / 2)


def calibrate(model: Model, texts: list[np.ndarray], labels: np.ndarray, least: int = 8) -> None:
    """A threshold for every language with enough toxic and other texts, and one for the rest."""
    tables = model.tables()
    values = np.concatenate([logits(model, tables, [model.rows(t)]) for t in texts])
    found = np.array([language_of(model, t) for t in texts])
    model.threshold = {"": best_threshold(values, labels)}
    for name in sorted(set(found)):
        own = found == name
        if name and labels[own].sum() >= least and (1 - labels[own]).sum() >= least:
            model.threshold[name] = best_threshold(values[own], labels[own])


def held_out(key: Column | str) -> Column:
    """Rows whose labels are not learned from."""
    return F.crc32(col(key).cast("string").cast("binary")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    """Train on at most `sample` labelled rows of each class, chosen by a hash of their key.

    Rows without key or label, and held-out ones, take no part; of several labels
    of a key the toxic one counts, of several rows of a key one. Equal texts count
    once.
    """
    known = labels.where(~held_out(key) & col("toxic").isNotNull()).groupBy(col(key).alias("k")).agg(F.max("toxic").alias("y"))
    known = known.withColumn("o", F.xxhash64("k", F.lit(SEED)))
    chosen = [known.where(c).orderBy("o", "k").limit(sample) for c in (col("y") == 1, col("y") == 0)]
    # At most 2 * sample rows: a bound that does not grow with the data.
    picked = F.broadcast(chosen[0].unionByName(chosen[1]))

    @F.arrow_udf("binary")
    def words(texts: pa.Array) -> pa.Array:
        read = Reader()
        made = (read(t.as_py()) for t in texts)
        return pa.array([m.astype("<i4").tobytes() if len(m) <= TRAIN_WORDS else None for m in made], pa.binary())

    held = docs.select(col(key).alias("of"), F.coalesce(col(text), F.lit("")).alias("text"))
    rows = held.join(picked, col("of") == col("k")).select("k", "y", "text")
    rows = rows.groupBy("k", "y").agg(F.min("text").alias("text")).select("k", "y", words("text").alias("w")).where("w is not null")
    seen = {}
    for r in sorted(rows.collect(), key=lambda r: str(r["k"])):
        seen.setdefault(bytes(r["w"]), int(r["y"]))
    texts = [np.frombuffer(w, dtype="<i4") for w in seen]
    return train(texts, np.array(list(seen.values()), dtype=np.float64))


def score(model: Model, text: Column | str) -> Column:
    """Score of a text from 0 to 1; at 0.5 and above it counts as toxic.

    NULL and empty texts are scored like a text of unknown words. Whole texts are
    read, whatever their length.
    """
    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        read, tables = Reader(), model.tables()

        def scored(group: list[np.ndarray]) -> list[float]:
            values = logits(model, tables, [model.rows(t) for t in group])
            shift = [model.threshold.get(language_of(model, t), model.threshold[""]) for t in group]
            return (1 / (1 + np.exp(-np.clip(values - shift, -30, 30)))).tolist()

        for batch in batches:
            group, size = [], 0
            for t in batch:
                group.append(read(t.as_py() or ""))
                size += len(group[-1])
                if size > 50_000:
                    yield pa.array(scored(group), pa.float64())
                    group, size = [], 0
            if group:
                yield pa.array(scored(group), pa.float64())

    return F.round(run(F.coalesce(col(text), F.lit(""))), 6)


def judge(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add `score` and `predicted`; input columns of these names give way."""
    docs = without(docs, "score", "predicted")
    made = docs.select("*", F.inline(F.array(F.struct(score(model, text).alias("score")))))
    return made.withColumn("predicted", (col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows that are not toxic, with the columns of the input."""
    held = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), col(text).alias("text"))
    return judge(held, model).where("predicted = 0").select("row.*")
