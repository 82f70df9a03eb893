"""Language identification in two steps: the family first, then one-versus-one linear SVMs within it.

Features are counts of hashed byte n-grams (2 to 4) of the whole text, ASCII letters lower-cased
and other ASCII signs taken as spaces. Families and, within each family, languages are separated by
pairwise linear SVMs without a bias, trained here on a bounded sample; the pair winners vote, and
margins break ties. A prediction sums weights over the whole text, so a text of any length takes
one pass.

Learning uses text and non-null lang of documents whose crc32 of the id (as text) is not a multiple
of 5, at most `per_lang` documents of each language (chosen by a hash of the id, evenly over all rows); every language is learned.

Defined results: a null text or one without a letter is `und` with score 0, as is every text if no
labelled document exists; with one learned language its score is 1; a null id counts as held out;
repeated rows give equal rows; an empty table gives an empty table; columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Families of common languages; a language not named here is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
}
ORDERS, WIDTH = (2, 3, 4), 4096
#: The bounds of the sample: documents of one language, fewer where languages share MOST documents, but never fewer than LEAST.
PER_LANG, MOST, LEAST = 500, 2000, 100
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def has_letter(text: str | None) -> bool:
    """Whether any character is a letter by its Unicode class; number signs such as one half are none."""
    return any(map(str.isalpha, text or ""))


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), f"only-{lang}")


def _joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, each between spaces, and where each starts (with the end of the last)."""
    parts = [b" " + (t or "").encode("utf-8", "surrogatepass").translate(_TABLE) + b" " for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), starts


def _grams(data: np.ndarray) -> Iterator[np.ndarray]:
    """For each order the feature number at every place; the last places of the data have none."""
    code = data.astype(np.uint32)
    for k, n in enumerate(ORDERS):
        if len(data) < n:
            yield np.zeros(0, np.int64)
            continue
        h = code[: len(code) - n + 1].copy()
        for i in range(1, n):
            h = h * np.uint32(257) + code[i : len(code) - n + 1 + i]
        yield ((h * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64) + k * WIDTH


def counts_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, counts) of one text."""
    data, _ = _joined([text])
    return np.unique(np.concatenate(list(_grams(data))), return_counts=True)


@dataclass
class Model:
    langs: list[str]
    families: list[str]
    #: ("family" or a family, first, second): the sign of the column's sum chooses.
    pairs: list[tuple[str, str, str]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((len(ORDERS) * WIDTH, 0), np.float32))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def sums(self, texts: list[str | None]) -> np.ndarray:
        """Mean weight per n-gram, a row for each text and a column for each pair."""
        data, starts = _joined(texts)
        total = np.zeros((len(texts), len(self.pairs)))
        for g, n in zip(_grams(data), ORDERS):
            for j in range(len(self.pairs)):
                run = np.concatenate([np.zeros(1), np.cumsum(self.weights[:, j][g], dtype=np.float64)])
                ends = np.minimum(starts[1:] - n + 1, len(g))
                begins = np.minimum(starts[:-1], len(g))
                total[:, j] += run[np.maximum(ends, begins)] - run[begins]
        size = np.maximum(1, np.diff(starts))[:, None]
        return total / size

    def predict(self, texts: list[str | None]) -> list[tuple[str, str, float]]:
        """(language, family, score) of each text."""
        if not self.langs:
            return [("und", "und", 0.0)] * len(texts)
        chance = 1 / (1 + np.exp(-np.clip(self.sums(texts) * self.scale, -30, 30)))
        out = []
        for t, p in zip(texts, chance):
            if not has_letter(t):
                out.append(("und", "und", 0.0))
                continue
            fam, a = self._vote("family", self.families, p)
            lang, b = self._vote(fam, [x for x in self.langs if family_of(x) == fam], p)
            out.append((lang, fam, min(a, b)))
        return out

    def _vote(self, group: str, names: list[str], p: np.ndarray) -> tuple[str, float]:
        won, sure = dict.fromkeys(names, 0.0), dict.fromkeys(names, 1.0)
        for j, (g, x, y) in enumerate(self.pairs):
            if g == group:
                won[x if p[j] >= 0.5 else y] += 1
                won[x] += p[j] / 100
                won[y] += (1 - p[j]) / 100
                sure[x], sure[y] = min(sure[x], p[j]), min(sure[y], 1 - p[j])
        best = max(names, key=lambda v: (won[v], v))
        return best, float(sure[best])


Row = tuple[np.ndarray, np.ndarray]


def svm(rows: list[Row], y: np.ndarray, width: int, c: float = 10.0, epochs: int = 40) -> np.ndarray:
    """Weights by dual coordinate descent for the squared hinge, over sparse rows (feature numbers, values of norm 1): memory for the rows and one vector."""
    w, alpha = np.zeros(width), np.zeros(len(rows))
    diag = [float(v @ v) + 0.5 / c for _, v in rows]
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            new = max(0.0, alpha[i] - (y[i] * float(w[at] @ v) - 1 + alpha[i] * 0.5 / c) / diag[i])
            if abs(new - alpha[i]) > 1e-6:
                w[at] += (new - alpha[i]) * y[i] * v
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def train(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """rows: (language, feature numbers, counts)."""
    langs = sorted({r[0] for r in rows})
    families = sorted({family_of(x) for x in langs})
    width = len(ORDERS) * WIDTH
    norm = [max(1e-9, float(np.sqrt(np.sum(n.astype(np.float64) ** 2)))) for _, _, n in rows]
    ratio = float(np.mean([n.sum() / len(ORDERS) / v for (_, _, n), v in zip(rows, norm)])) if rows else 1.0
    unit: list[Row] = [(at, n.astype(np.float64) / v) for (_, at, n), v in zip(rows, norm)]
    lang_of, fam_of = np.array([r[0] for r in rows]), np.array([family_of(r[0]) for r in rows])
    pairs, weights, scale = [], [], []

    def add(group: str, names: list[str], label: np.ndarray) -> None:
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                at = np.flatnonzero((label == a) | (label == b))
                pairs.append((group, a, b))
                weights.append(svm([unit[k] for k in at], np.where(label[at] == a, 1.0, -1.0), width).astype(np.float32))
                scale.append(3.0 * ratio)

    add("family", families, fam_of)
    for fam in families:
        add(fam, [v for v in langs if family_of(v) == fam], lang_of)
    table = np.stack(weights, axis=1) if weights else np.zeros((width, 0), np.float32)
    return Model(langs, families, pairs, table, np.array(scale))


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [counts_of(t) for t in b.column("text").to_pylist()]
        at = [a.astype("<u2").tobytes() for a, _ in got]
        n = [c.astype("<u4").tobytes() for _, c in got]
        yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("h"), pa.array(at, pa.binary()), pa.array(n, pa.binary())], ["lang", "h", "at", "n"])


def learn(docs: DataFrame, per_lang: int = PER_LANG) -> Model:
    """A model of every language that occurs, from the bounded sample.

    The driver gets language counts and per_lang sparse vectors of each language at most: rows are ranked within
    their language before any leaves its task, so an id or a text that repeats without end adds no more.
    """
    labelled = docs.where(F.col("lang").isNotNull() & ~held_out())
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    if not sizes:
        return Model([], [])
    per_lang = min(per_lang, max(LEAST, MOST // len(sizes)))
    steps = 1 << 30
    limits = docs.sparkSession.createDataFrame([(r["lang"], int(steps * min(1.0, 1.2 * per_lang / r["n"]))) for r in sizes], "lang string, most long")
    hashed = labelled.where(F.col("text").isNotNull()).select("lang", "text", F.pmod(F.xxhash64("doc_id"), F.lit(steps)).alias("h"))
    near = hashed.join(F.broadcast(limits), "lang").where(F.col("h") < F.col("most"))  # a row per language
    nth = F.row_number().over(W.partitionBy("lang").orderBy("h", F.xxhash64("text")))
    picked = near.withColumn("nth", nth).where(F.col("nth") <= per_lang).select("lang", "text", "h")
    rows = picked.mapInArrow(_featurize, "lang string, h long, at binary, n binary").collect()
    rows.sort(key=lambda r: (r["lang"], r["h"], bytes(r["at"]), bytes(r["n"])))
    return train([(r["lang"], np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["n"], "<u4").astype(np.float32)) for r in rows])


def _labeller(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, got, part, size = b.column("text").to_pylist(), [], [], 0
            for t in texts:
                part.append(t)
                size += len(t or "") + 2
                if size > 400_000:
                    got += model.predict(part)
                    part, size = [], 0
            got += model.predict(part) if part else []
            cols = [pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.float64()))]
            keep = [b.column(i) for i, name in enumerate(b.schema.names) if name != "text"]
            yield pa.RecordBatch.from_arrays(keep + cols, [x for x in b.schema.names if x != "text"] + ["lang_pred", "family", "score"])

    return run


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, family, score."""
    model = model or learn(docs)
    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(_labeller(model), "doc_id long, held_out boolean, lang_pred string, family string, score double")


def stage(spark, docs: DataFrame, sf_dir: str, min_score: float = 0.5) -> DataFrame:
    """Pipeline stage: documents with a language that scores min_score at least stay; texts without letters go."""
    schema = docs.schema
    model = learn(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                got = model.predict(b.column("text").to_pylist())
                yield b.filter(pa.array([g[0] != "und" and g[2] >= min_score for g in got], pa.bool_()))

    return docs.mapInArrow(run, schema)
