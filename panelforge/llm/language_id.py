"""Operator 10: language identification by a bidirectional gated recurrent network over bytes.

The network (numpy, trained by backpropagation through time with Adam) reads a
text's letters: A-Z lower-cased, other ASCII characters as single spaces. A
text is cut into windows of whole words, ``WINDOW`` bytes at most (longer words
are cut between characters), both directions run over every window, every letter
of the whole text gets class probabilities, and their mean logarithm over all
positions gives the document's probabilities.

Training takes a bounded sample of the windows of all labelled texts, each text from
its beginning to its end: the same number of distinct windows with a letter for each
language, ``SAMPLE_WINDOWS`` in all, those whose hash is smallest. The languages are
those of all labelled rows with a letter, however rare, and short texts give short
windows. Scoring covers every row and every letter; a letter is what Unicode counts
as one (category L) for training and scoring alike. Weights are some ten KB and
travel as a broadcast.

Defined results: a null text or one without letters is ``und`` with score 0;
without any labelled row every text is ``und``; with one language all others are
it; very long texts are many windows; equal probabilities go to the language that
is first by name; a text labelled with several languages is an example of each; repeated rows and null ids
are scored like any other; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import with_rest

HIDDEN, WINDOW = 8, 64
SAMPLE_WINDOWS = 12_000
EPOCHS, LEAST_STEPS, BATCH, RATE, SEED = 8, 300, 128, 0.02, 7
GROUP_BYTES = 1 << 20

_MAYBE_LETTER = re.compile(r"[^\W\d_]")
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def lettered(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def normal(text: bytes) -> bytes:
    return b" ".join(text.translate(_TABLE).split())


def new_weights(classes: int, hidden: int = HIDDEN, seed: int = SEED) -> dict[str, np.ndarray]:
    """Per direction (f, b) and gate (z update, r reset, m candidate): input rows by byte with bias, recurrent weights."""
    rng = np.random.default_rng(seed)
    w = {}
    for d in "fb":
        for gate in "zrm":
            w[f"e{gate}{d}"] = (rng.normal(size=(256, hidden)) * 0.5).astype(np.float32)
            w[f"u{gate}{d}"] = (rng.normal(size=(hidden, hidden)) / np.sqrt(hidden)).astype(np.float32)
    w["o"] = (rng.normal(size=(2 * hidden, classes)) * 0.3).astype(np.float32)
    w["c"] = np.zeros(classes, np.float32)
    return w


def run_direction(x: np.ndarray, w: dict, d: str, kept: list | None = None) -> np.ndarray:
    """x: bytes (steps, windows). Hidden states (steps, windows, hidden); gates clip(a / 4 + 1 / 2), candidate a / (1 + |a|)."""
    ez, er = (w[f"e{g}{d}"] * np.float32(0.25) + np.float32(0.5) for g in "zr")
    uz, ur = (w[f"u{g}{d}"] * np.float32(0.25) for g in "zr")
    em, um = w[f"em{d}"], w[f"um{d}"]
    h = np.zeros((x.shape[1], em.shape[1]), np.float32)
    out = np.empty((len(x), *h.shape), np.float32)
    for t, row in enumerate(x):
        z = h @ uz
        z += ez.take(row, axis=0)
        np.clip(z, 0, 1, out=z)
        r = h @ ur
        r += er.take(row, axis=0)
        np.clip(r, 0, 1, out=r)
        m = (r * h) @ um
        m += em.take(row, axis=0)
        size = np.abs(m)
        size += 1
        m /= size
        if kept is not None:
            kept.append((h, z, r, m.copy(), size))
        m -= h
        m *= z
        m += h
        out[t] = h = m
    return out


def log_probabilities(w: dict, hf: np.ndarray, hb: np.ndarray) -> np.ndarray:
    """Log class probabilities at every position: (classes, steps, windows)."""
    hidden = hf.shape[2]
    s = hf @ w["o"][:hidden]
    s += hb @ w["o"][hidden:]
    s += w["c"]
    s = np.ascontiguousarray(np.moveaxis(s, 2, 0))
    s -= s.max(axis=0)
    s -= np.log(np.exp(s).sum(axis=0))
    return s


def scored(w: dict, x: np.ndarray) -> np.ndarray:
    return log_probabilities(w, run_direction(x, w, "f"), run_direction(x[::-1], w, "b")[::-1])


def _back(x: np.ndarray, w: dict, d: str, kept: list, dh_all: np.ndarray, g: dict) -> None:
    """Add this direction's gradients to g."""
    for gate in "zrm":
        g[f"e{gate}{d}"], g[f"u{gate}{d}"] = np.zeros_like(w[f"e{gate}{d}"]), np.zeros_like(w[f"u{gate}{d}"])
    carry = np.zeros_like(dh_all[0])
    for t in range(len(x) - 1, -1, -1):
        h, z, r, m, size = kept[t]
        dh = dh_all[t] + carry
        dm = dh * z / (size * size)
        dz = dh * (m - h) * ((z > 0) & (z < 1)) * np.float32(0.25)
        back = dm @ w[f"um{d}"].T
        dr = back * h * ((r > 0) & (r < 1)) * np.float32(0.25)
        hot = np.zeros((256, len(h)), np.float32)
        hot[x[t], np.arange(len(h))] = 1
        for gate, da, source in (("z", dz, h), ("r", dr, h), ("m", dm, r * h)):
            g[f"u{gate}{d}"] += source.T @ da
            g[f"e{gate}{d}"] += hot @ da
        carry = dh * (1 - z) + back * r + dz @ w[f"uz{d}"].T + dr @ w[f"ur{d}"].T


def train(windows: np.ndarray, filled: np.ndarray, labels: np.ndarray, classes: int, epochs: int = EPOCHS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Fit to windows (bytes: windows, steps; the first ``filled`` of each count) with a class each; classes weigh the same."""
    w, rng = new_weights(classes, seed=seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    weight = len(labels) / (classes * np.maximum(1, np.bincount(labels, minlength=classes)))
    batches = -(-len(windows) // BATCH)
    epochs = max(epochs, -(-LEAST_STEPS // batches))
    steps, total = 0, epochs * batches
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for a in range(0, len(order), BATCH):
            at = order[a : a + BATCH]
            x, y = np.ascontiguousarray(windows[at].T), labels[at]
            kf, kb, g = [], [], {}
            hf, hb = run_direction(x, w, "f", kf), run_direction(x[::-1], w, "b", kb)
            p = np.exp(log_probabilities(w, hf, hb[::-1]))
            p[y, :, np.arange(len(y))] -= 1
            p *= np.arange(len(x))[:, None] < filled[at]
            p = np.moveaxis(p * (weight[y] / (len(y) * filled[at])).astype(np.float32), 0, 2)
            hidden = hf.shape[2]
            dh = p @ w["o"].T
            g["c"], flat = p.sum(axis=(0, 1)), p.reshape(-1, classes)
            g["o"] = np.concatenate([hf.reshape(-1, hidden).T @ flat, hb[::-1].reshape(-1, hidden).T @ flat])
            _back(x, w, "f", kf, dh[..., :hidden], g)
            _back(x[::-1], w, "b", kb, dh[::-1, :, hidden:], g)
            steps += 1
            rate = RATE * (1 - steps / (total + 1))
            norm = float(np.sqrt(sum((v * v).sum() for v in g.values())))
            for k, v in g.items():
                v = v * min(1.0, 1.0 / (norm + 1e-9))
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.001 * (v * v - second[k])
                w[k] -= rate * (first[k] / (1 - 0.9**steps)) / (np.sqrt(second[k] / (1 - 0.999**steps)) + 1e-8)
    return w


def cut(text: bytes, window: int = WINDOW) -> list[bytes]:
    """Windows of whole words of a normalised text; what is longer than a window is cut between characters."""
    out, a, n = [], 0, len(text)
    while n - a > window:
        b = text.rfind(b" ", a + 1, a + window + 1)
        if b < 0:
            b = a + window
            while b > a + 1 and text[b] & 0xC0 == 0x80:
                b -= 1
            out.append(text[a:b])
            a = b
        else:
            out.append(text[a:b])
            a = b + 1
    if a < n:
        out.append(text[a:])
    return out


def padded(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes: windows, steps, with spaces behind; bytes that count in each)."""
    joined = b"".join([x.ljust(WINDOW) for x in windows])
    return np.frombuffer(joined, np.uint8).reshape(-1, WINDOW), np.array([len(x) for x in windows], np.int64)


def sample(labelled: DataFrame, text_col: str, lang_col: str, windows: int) -> list[tuple[str, bytes]]:
    """(lang, window) of some windows // languages windows of each language, in order of language and hash."""
    t = labelled.where(F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string").alias("t"), F.col(lang_col).alias("lang")).where(lettered(F.col("t")))
    sizes = t.groupBy("lang", F.xxhash64("t").alias("h")).agg((F.max(F.octet_length("t")) / WINDOW + 1).alias("n"))
    values = {r["lang"]: r["n"] for r in sizes.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    each = max(1, windows // max(1, len(values)))

    def least(some: DataFrame, limits: dict[str, int]) -> list:
        """The windows of the ``each`` least hashes of every language, of those below its limit."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = {}
                for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    limit = limits[lang]
                    for piece in cut(normal(text.encode())):
                        h = xxhash.xxh64_intdigest(piece) - (1 << 63)
                        if h <= limit and has_letter(piece.decode()):
                            out[lang, h] = piece
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.string()), pa.array([k[1] for k in out], pa.int64()), pa.array(list(out.values()), pa.binary())], names=["lang", "h", "piece"])

        found = some.mapInArrow(run, "lang string, h long, piece binary").groupBy("lang", "h").agg(F.min("piece").alias("piece"))
        return found.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= each).select("lang", "h", "piece").collect()

    # a threshold for each language leaves some two times the windows wanted, whatever the size of the table; where most of
    # a language's windows repeat or hold no letter it leaves too few, and a pass over that language raises it
    shares, rows = {lang: 2 * each / n if n > 4 * each else 1.0 for lang, n in values.items()}, []
    while shares:
        found = least(t if len(shares) == len(values) else t.where(F.col("lang").isin(*shares)), {lang: min(int(2**64 * share), 2**64 - 1) - 2**63 for lang, share in shares.items()})
        count = Counter(r["lang"] for r in found)
        again = {lang for lang, share in shares.items() if share < 1 and count[lang] < each}
        rows += [r for r in found if r["lang"] not in again]
        shares = {lang: min(1.0, 16 * shares[lang]) for lang in again}
    return [(r["lang"], bytes(r["piece"])) for r in sorted(rows, key=lambda r: (r["lang"], r["h"]))]


def has_letter(text: str) -> bool:
    return any(unicodedata.category(m[0])[0] == "L" for m in _MAYBE_LETTER.finditer(text))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", windows: int = SAMPLE_WINDOWS) -> tuple[list[str], dict]:
    """(languages, weights) from a bounded sample of ``windows`` windows of the labelled rows' whole texts."""
    found = sample(labelled, text_col, lang_col, windows)
    if not found:
        return [], {}
    languages = sorted({lang for lang, _ in found})
    x, filled = padded([piece for _, piece in found])
    return languages, train(x, filled, np.array([languages.index(lang) for lang, _ in found]), len(languages))


def _document_scores(w: dict, texts: list[bytes], classes: int) -> np.ndarray:
    """Mean log probabilities over all positions of each normalised text."""
    out = np.zeros((len(texts), classes))
    pieces = [cut(t) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(p) for p in pieces])
    x, filled = padded([p for own in pieces for p in own])
    for a in range(0, len(x), 1024):
        part = scored(w, np.ascontiguousarray(x[a : a + 1024].T))
        part *= np.arange(WINDOW)[:, None] < filled[a : a + 1024]
        np.add.at(out, owner[a : a + 1024], part.sum(axis=1, dtype=np.float64).T)
    return out / np.maximum(1, np.bincount(owner, weights=filled, minlength=len(texts)))[:, None]


def language_id(docs: DataFrame, model: tuple[list[str], dict], id_col: str = "doc_id", text_col: str = "text", rest: tuple[str, ...] | None = None) -> DataFrame:
    """doc_id, lang_pred, score of each row and, if asked, its text and other columns in the struct rest."""
    languages, weights = model
    shared, more = docs.sparkSession.sparkContext.broadcast(weights), 2 if rest is None else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            langs, scores = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            group: list[tuple[int, bytes]] = []

            def work() -> None:
                got = _document_scores(w, [t for _, t in group], len(languages))
                # certainty of a whole text from its mean position: a softmax of the means, sharpened by length up to a window
                got *= np.minimum(WINDOW, np.array([len(t) for _, t in group]))[:, None] ** 0.5
                p = np.exp(got - got.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                for (row, _), best, most in zip(group, p.argmax(axis=1), p.max(axis=1)):
                    langs[row], scores[row] = languages[best], most
                group.clear()

            held, letters = 0, batch.column(batch.num_columns - 1)
            for row, text in enumerate(batch.column(1).to_pylist()):
                if languages and text and letters[row].as_py():
                    group.append((row, normal(text.encode())))
                    held += len(group[-1][1])
                if held >= GROUP_BYTES:
                    work()
                    held = 0
            if group:
                work()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), *batch.columns[more:-1]], names=["doc_id", "lang_pred", "score", *batch.schema.names[more:-1]])

    named, schema = with_rest(docs, id_col, text_col, rest)
    return named.withColumn("has a letter", lettered(F.col("text"))).mapInArrow(run, f"doc_id long, lang_pred string, score double{schema}")
