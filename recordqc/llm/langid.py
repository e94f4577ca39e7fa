"""Language ID by segmentation-marginalised unigrams.

A fixed public vocabulary gives the pieces. Each language has a probability for
each piece; a word's probability is the sum over all its segmentations into
pieces, computed by a forward pass. The text's score is the product over words.
Probabilities are fitted by expectation maximisation over the same lattices.

Fitting uses a bounded sample: of each language at most ``sample`` different texts
(lowest hash), whole, and their ``types`` most frequent words of
at most ``MAX_FIT`` characters. Prediction reads every text whole and nothing
but the text. Words are runs without ASCII other than letters, in lower case.

A text that is null or has no letter is ``und`` with score 0; so is every text
when no language could be learned. Ties go to the first language by name.
Repeated rows count as often as they occur. Extra columns pass through; columns
named like the result's are replaced.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType
from pyspark.sql.window import Window

from recordqc.llm.common import map_batches, stored, texts_of

#: Bytes of ASCII characters other than letters become spaces; text is in lower case before.
LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
START, MAX_PIECE, MAX_FIT = "▁", 12, 40
#: Share of probability left to characters that no piece covers, each one of so many.
UNKNOWN, CHARS = 1e-4, 1e4
_M = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(LETTERS).split()


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def vocabulary(path: str) -> list[str]:
    """Lower-case letter pieces of a sentencepiece model, of at most ``MAX_PIECE`` characters."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i) for i in range(model.get_piece_size())}
    return sorted(p for p in pieces if 0 < len(p) <= MAX_PIECE and p == p.lower() and p.lstrip(START).isalpha() or p == START)


def _mixed(codes: np.ndarray, length: int) -> np.ndarray:
    """Hash of every substring of ``length`` symbols along the last axis."""
    n = codes.shape[-1] - length + 1
    h = np.full((*codes.shape[:-1], n), length, np.uint64)
    for k in range(length):
        h = (h ^ codes[..., k:k + n]) * _M
        h ^= h >> np.uint64(31)
    return h


class Pieces:
    """Looks up substrings among the pieces."""

    def __init__(self, pieces: list[str]):
        by = defaultdict(list)
        for i, p in enumerate(pieces):
            by[len(p)].append((int(_mixed(np.array([[*map(ord, p)]], np.uint64), len(p))[0, 0]), i))
        self.unknown = len(pieces)
        self.tables = {n: (np.array([h for h, _ in sorted(x)], np.uint64), np.array([i for _, i in sorted(x)], np.int32)) for n, x in by.items()}

    def lattice(self, words: list[str]) -> np.ndarray:
        """[word, end, length - 1] -> piece id or -1, for words of one length (with ``START`` before each).

        A single character that is no piece is the unknown piece.
        """
        codes = np.frombuffer("".join(START + w for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64).reshape(len(words), -1)
        size = codes.shape[1]
        out = np.full((len(words), size, min(MAX_PIECE, size)), -1, np.int32)
        for n, (hashes, ids) in self.tables.items():
            if n <= size:
                h = _mixed(codes, n)
                at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                out[:, n - 1:, n - 1] = np.where(hashes[at] == h, ids[at], -1)
        first = out[:, :, 0]
        first[first < 0] = self.unknown
        return out


def forward(lattice: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Log-probability of each word under each language; ``p`` [piece + 1, language], its last row for unknowns."""
    n, size, most = lattice.shape
    p = np.vstack([p, np.zeros(p.shape[1])])  # -1 looks up zero
    past, scale = np.zeros((n, most, p.shape[1])), np.zeros(n)
    past[:, 0] = 1.0  # past[:, k] is the mass k + 1 symbols back
    for end in range(size):
        k = min(most, end + 1)
        now = np.einsum("nkl,nkl->nl", past[:, :k], p[lattice[:, end, :k]])
        past[:, 1:] = past[:, :-1].copy()
        past[:, 0] = now
        if end % 8 == 7:  # unknowns cost 1e-8 a symbol: far from the smallest double
            top = past.max(axis=(1, 2))
            past /= top[:, None, None]
            scale += np.log(top)
    return np.log(np.maximum(past[:, 0], 1e-300)) + scale[:, None]


def by_length(words: list[str], block: int = 20_000):
    """Indices of words of equal length, in blocks of bounded size."""
    groups = defaultdict(list)
    for i, w in enumerate(words):
        groups[len(w)].append(i)
    for size, at in groups.items():
        step = max(1, block * 8 // (size + 1))
        for i in range(0, len(at), step):
            yield at[i:i + step]


def fit(pieces: Pieces, words: list[str], counts: np.ndarray, rounds: int = 4, prior: float = 0.02) -> np.ndarray:
    """Piece probabilities [piece + 1, language] from word counts [word, language], by expectation maximisation."""
    languages = counts.shape[1]
    p = np.full((pieces.unknown + 1, languages), (1 - UNKNOWN) / pieces.unknown)
    p[-1] = UNKNOWN / CHARS
    lattices = [(at, pieces.lattice([words[i] for i in at])) for at in by_length(words)]
    for _ in range(rounds):
        seen = np.full((pieces.unknown + 1, languages), prior)
        for at, lattice in lattices:
            n, size, most = lattice.shape
            q = np.vstack([p, np.zeros(languages)])[lattice]
            alpha, beta = np.zeros((n, size + 1, languages)), np.zeros((n, size + 1, languages))
            alpha[:, 0] = beta[:, size] = 1.0
            for end in range(size):
                for k in range(min(most, end + 1)):
                    alpha[:, end + 1] += alpha[:, end - k] * q[:, end, k]
            for end in range(size - 1, -1, -1):
                for k in range(min(most, end + 1)):
                    beta[:, end - k] += beta[:, end + 1] * q[:, end, k]
            weight = counts[at] / np.maximum(alpha[:, size], 1e-300)
            for k in range(most):
                got = alpha[:, :size - k] * q[:, k:, k] * beta[:, k + 1:] * weight[:, None]
                ids = lattice[:, k:, k].ravel()
                for lang in range(languages):
                    seen[:, lang] += np.bincount(ids + 1, got[..., lang].ravel(), pieces.unknown + 2)[1:]
        known = seen[:-1]
        p[:-1] = (1 - UNKNOWN) * known / known.sum(0)
    return p


def train(rows: DataFrame, pieces: Pieces, sample: int, types: int):
    """(languages, log prior, p) from ``text, lang`` rows with a language."""
    hashed = rows.select("lang", "text", F.xxhash64("text", "lang").alias("h"))
    order = Window.partitionBy("lang").orderBy("h")  # hashes alone are ranked; a row limit up to 1,000 holds before the shuffle
    cut = hashed.select("lang", "h").distinct().withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= sample) \
        .groupBy("lang").agg(F.max("h").alias("__cut"))
    cut = stored(cut, "language-cut")  # a row a language: known to be small before texts meet it
    chosen = hashed.join(cut, "lang").where("h <= __cut").dropDuplicates(["lang", "h"]).select("lang", "text")

    def made(batches):
        import pyarrow as pa
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), texts_of(b)):
                words = [w[i:i + MAX_FIT] for w in (x.decode() for x in words_of(text)) for i in range(0, len(w), MAX_FIT)]
                if words:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words)), pa.array(words)], names=["lang", "word"])

    counted = chosen.mapInArrow(made, "lang string, word string").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    top = counted.withColumn("__k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("__k") <= types)
    got = top.select("lang", "word", "n").toPandas()  # at most ``types`` rows a language
    languages = sorted(got["lang"].unique())
    words = sorted(got["word"].unique())
    counts = np.zeros((len(words), len(languages)))
    counts[np.searchsorted(np.array(words, object), got["word"].to_numpy()), np.searchsorted(np.array(languages, object), got["lang"].to_numpy())] = got["n"]
    return languages, fit(pieces, words, counts) if languages else None


def predict(docs: DataFrame, train_on: DataFrame, vocabulary_path: str = "/opt/tokenizers/piece_bpe_32k.model", sample: int = 1000,
            types: int = 30_000, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (posterior of the predicted language, languages equally likely before).

    ``train_on`` has ``text, lang``; rows without a language are left out.
    """
    vocab = vocabulary(vocabulary_path)
    languages, p = train(train_on.where("lang is not null and text is not null").select("lang", "text"), Pieces(vocab), sample, types)
    sent = docs.sparkSession.sparkContext.broadcast((vocab, p))  # vocabulary x languages numbers
    cache = {}

    def score(words: list[str]) -> np.ndarray:
        if not cache:
            cache["pieces"], cache["p"] = Pieces(sent.value[0]), sent.value[1]
        out = np.zeros((len(words), len(languages)))
        for at in by_length(words):
            out[at] = forward(cache["pieces"].lattice([words[i] for i in at]), cache["p"])
        return out

    def made(batch):
        preds, scores, block, letters, n = [], [], [], [], 0
        texts = texts_of(batch)

        def flush():
            index: dict[bytes, int] = {}
            ids, ends = [], []
            for words in block:
                ids.extend([index.setdefault(w, len(index)) for w in words])
                ends.append(len(ids))
            table = score([w.decode() for w in index])
            sums = np.zeros((len(ids) + 1, len(languages)))
            np.cumsum(table[ids], axis=0, out=sums[1:])
            total = np.diff(sums[[0, *ends]], axis=0)
            total -= total.max(axis=1, keepdims=True)
            best = total.argmax(axis=1)
            post = 1 / np.exp(total).sum(axis=1)
            preds.extend(languages[b] if ok else "und" for b, ok in zip(best, letters))
            scores.extend(float(s) if ok else 0.0 for s, ok in zip(post, letters))

        for text in texts:
            ok = bool(languages) and has_letter(text)
            block.append(words_of(text) if ok else [])
            letters.append(ok)
            n += len(block[-1])
            if n > 2_000_000:  # words whose sums are held at once
                flush()
                block.clear(), letters.clear()
                n = 0
        if block:
            if languages:
                flush()
            else:
                preds.extend(["und"] * len(block))
                scores.extend([0.0] * len(block))
        return [preds, scores]

    docs = docs.drop("lang_pred", "score")
    return map_batches(docs, made, [("lang_pred", StringType()), ("score", DoubleType())], [c for c in docs.columns if keep_text or c != "text"])
