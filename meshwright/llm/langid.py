"""Language identification by nearest centroids of TF-IDF byte n-grams.

Texts, without the words that hold a digit or an @ (numbers, addresses, keys belong to no
language) and with signs taken for spaces (a table or shouting is no language either), become counts of hashed 2- and 3-byte n-grams of their lower-cased UTF-8 bytes,
damped by a square root, weighted by inverse document frequency and normalised. Each language
holds several centroids, found by spherical k-means on its training vectors; a text takes the
language of the centroid with the highest cosine. A text whose best cosine lies below a
floor for its length, learnt from the training texts, is rejected: other scripts, unknown
languages, code and random letters lie below it, at every length from a few words up.

The classifier is fitted on at most ``per_lang`` labelled rows of each language, those with
the smallest hash of id and text, of each at most ``max_chars`` characters (a bounded sample;
its bounds are parameters). Prediction is a map over all rows, whole texts, with the model
(under 2 MB) sent to each task.

Defined cases: a text that is null or has no letter is ``und``, score 0, rejected; ties
between centroids go to the language that sorts first; equal texts get equal answers; with
no training rows every text is ``und``; fewer than 20 training rows teach no floor (all 0);
an empty table gives no rows; other columns pass through ``keep_spoken`` untouched and are
ignored by ``predict``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.llm.common import fold_of, small_arrow_batches

DIM = 1 << 12
CHUNK = 1 << 21
MARKED = re.compile(r"\S*[0-9@]\S*")
#: ASCII and Latin-1 signs, general and ideographic punctuation.
SIGNS = re.compile("[\x00-\x40\x5b-\x60\x7b-\xa9\xab-\xb4\xb6-\xb9\xbb-\xbf\xd7\xf7\u2000-\u206f\u3000-\u3004\u3008-\u3020]+")


def plain(text: str) -> str:
    """The text without words that hold a digit or an @ (unless no letter is left), signs as spaces."""
    left = MARKED.sub(" ", text)
    return SIGNS.sub(" ", left if any(map(str.isalpha, left)) else text)


def grams(texts: list[str], dim: int = DIM) -> np.ndarray:
    """Square-rooted counts of hashed byte 2- and 3-grams, one row a text (float32)."""
    raw = [b" " + plain(t).lower().encode("utf-8", "replace") + b" " for t in texts]
    out = np.zeros((len(raw), dim), np.float32)
    lengths = np.array([len(r) for r in raw], np.int64)
    start = 0
    while start < len(raw):  # pieces of bounded size; one text longer than a piece is cut with overlap
        if lengths[start] > CHUNK:
            body = raw[start]
            for at in range(0, len(body), CHUNK):
                _count(body[at : at + CHUNK + 2], None, out[start : start + 1], dim)
            start += 1
            continue
        stop, total = start, 0
        while stop < len(raw) and (stop == start or total + lengths[stop] <= CHUNK):
            total += lengths[stop]
            stop += 1
        _count(b"".join(raw[start:stop]), lengths[start:stop], out[start:stop], dim)
        start = stop
    return np.sqrt(out, out=out)


def _count(body: bytes, lengths: np.ndarray | None, out: np.ndarray, dim: int) -> None:
    b = np.frombuffer(body, np.uint8).astype(np.uint32)
    if len(b) < 2:
        return
    row = np.zeros(len(b), np.int64) if lengths is None else np.repeat(np.arange(len(lengths)), lengths)
    two = b[:-1] << np.uint32(8) | b[1:]
    for code, n in ((two, 2), (two[:-1] << np.uint32(8) | b[2:], 3)):
        if not len(code):
            continue
        slot = (code * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(32 - dim.bit_length() + 1)
        same = row[: len(code)] == row[n - 1 :]
        flat = row[: len(code)] * dim + slot
        out += np.bincount(flat[same], minlength=out.size).astype(np.float32).reshape(out.shape)


def length_bin(n_chars: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(n_chars, 1)).astype(int), 14)


class Model:
    """Centroids, weights and floors; small and picklable."""

    def __init__(self, langs: list[str], idf: np.ndarray, centroids: np.ndarray, owner: np.ndarray, floors: np.ndarray):
        self.langs, self.idf, self.centroids, self.owner, self.floors = langs, idf, centroids, owner, floors

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and cosine of each text."""
        x = grams(texts, len(self.idf)) * self.idf
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        cos = x @ self.centroids.T / np.maximum(norm, 1e-9)[:, None]
        best = cos.argmax(1)
        return self.owner[best], np.clip(cos[np.arange(len(best)), best], 0, 1)

    def predict(self, texts: list[str | None], block: int = 256) -> tuple[list[str], list[float], list[bool]]:
        lang, score, reject = [], [], []
        for at in range(0, len(texts), block):
            part = texts[at : at + block]
            live = [i for i, t in enumerate(part) if t and any(map(str.isalpha, t))] if self.langs else []
            l, s, r = ["und"] * len(part), [0.0] * len(part), [True] * len(part)
            if live:
                said = [part[i] for i in live]
                who, cos = self.score(said)
                floor = self.floors[length_bin(np.array([len(t) for t in said]))]
                for i, w, c, f in zip(live, who.tolist(), cos.tolist(), floor.tolist(), strict=True):
                    l[i], s[i], r[i] = self.langs[w], c, c < f
            lang += l
            score += s
            reject += r
        return lang, score, reject


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; empty clusters take the farthest rows."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        sim = x @ c.T
        who = sim.argmax(1)
        new = np.zeros_like(c)
        np.add.at(new, who, x)
        for j in np.flatnonzero(np.bincount(who, minlength=len(c)) == 0):
            new[j] = x[sim.max(1).argmin()]
        c = new / np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-9)
    return c


def fit_rows(texts: list[str], langs: list[str], k: int = 3, seed: int = 5, dim: int = DIM) -> Model:
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros(dim, np.float32), np.zeros((1, dim), np.float32), np.zeros(1, int), np.zeros(15))
    raw = np.concatenate([grams(texts[i : i + 256], dim) for i in range(0, len(texts), 256)])
    seen = (raw > 0).sum(0)
    idf = np.log((1 + len(raw)) / (1 + seen)).astype(np.float32) + np.float32(0.1)
    x = raw * idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    code = np.array([names.index(v) for v in langs])
    parts, owner = [], []
    for j in range(len(names)):
        c = kmeans(x[code == j], k, seed + j)
        parts.append(c)
        owner += [j] * len(c)
    centroids = np.concatenate(parts).astype(np.float32)
    best = (x @ centroids.T).max(1)
    bins = length_bin(np.array([len(t) for t in texts]))
    return Model(names, idf, centroids, np.array(owner), floors_of(best, bins))


def floors_of(best: np.ndarray, bins: np.ndarray, least: int = 20, near: int = 200, share: float = 0.6) -> np.ndarray:
    """A share of the lowest cosine of training texts as long or longer by at most one bin.

    Where those are fewer than ``near``, bins on both sides join in until they are enough (or
    all), so a sparse bin borrows from its neighbours. Fewer than ``least`` texts in all teach no
    floor.
    """
    floors = np.zeros(15)
    if len(best) < least:
        return floors
    near = min(near, len(best))
    for b in range(15):
        some = next(n for r in range(15) if len(n := best[(bins >= b - r) & (bins <= b + 1 + r)]) >= near)
        floors[b] = share * some.min()
    return np.minimum.accumulate(floors[::-1])[::-1]


def fit(train: DataFrame, per_lang: int = 400, max_rows: int = 80_000, k: int = 3, max_chars: int = 50_000) -> Model:
    """Fit on rows of (doc_id, text, lang) with at most per_lang rows of each language.

    No language is left out: with more than max_rows / per_lang of them each gives fewer rows.
    """
    rows = train.where("text IS NOT NULL AND lang IS NOT NULL AND text RLIKE '\\\\p{L}'").select(
        "lang", F.substring("text", 1, max_chars).alias("text"), F.xxhash64(F.lit(3), "doc_id", "text").alias("h"))
    sizes = [(r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()]
    if not sizes:
        return fit_rows([], [])
    per_lang = max(1, min(per_lang, max_rows // len(sizes)))
    # a cut of the hash that about twice per_lang rows of each language pass (20 more, so that
    # none is left without), then the smallest hashes
    cuts = [(lang, int(min(1.0, (2.0 * per_lang + 20) / n) * (1 << 64)) - (1 << 63) - 1) for lang, n in sizes]
    cut = F.broadcast(train.sparkSession.createDataFrame(cuts, "lang string, cut long"))
    # rows that repeat id and text are one row of the sample
    got = rows.join(cut, "lang").where("h <= cut").drop("cut").dropDuplicates(["lang", "h"]).toPandas().sort_values(["lang", "h", "text"]).groupby("lang").head(per_lang)
    return fit_rows(got["text"].tolist(), got["lang"].tolist(), k)


def fit_on_training_fold(docs: DataFrame, per_lang: int = 400) -> Model:
    """Fit on the documents whose crc32(doc_id as text) mod 5 is not 0."""
    return fit(docs.where(fold_of() != 0).select("doc_id", "text", "lang"), per_lang)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row; reads doc_id and text only."""
    spark = docs.sparkSession
    small_arrow_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, reject = shared.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(reject, pa.bool_())],
                names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, lang_pred string, score double, rejected boolean")


def keep_spoken(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model does not reject, all columns as they were."""
    spark = docs.sparkSession
    small_arrow_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, reject = shared.value.predict(batch.column(batch.schema.get_field_index("text")).to_pylist())
            yield batch.filter(pa.array([not r for r in reject], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
