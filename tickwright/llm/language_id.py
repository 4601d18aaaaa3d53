"""Language identification as mixture inference over character trigrams.

Training counts trigrams of letters per language over all training rows; each task sums its
own rows before the shuffle.  The model is ``2^BITS`` hashed trigrams per language, whatever
the size of the corpus, so it is small enough to send to every task.

For a document, expectation-maximisation estimates the share of each language, and of noise
that is spread evenly over trigrams, from the likelihoods of its trigrams.  Starting from the
best single language, the language with the largest share joins the set while the likelihood
gains more than its penalty.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwright.llm.common import in_batches, remainder, slices, texts, with_package

BITS = 15
ROUNDS = 10
#: Trigrams overlap, so each counts a third; a language must gain ``PENALTY`` times log(trigrams).
TEMPER, PENALTY = 1 / 3, 1.0
#: Share of a language's probability that is spread over all trigrams, seen or not.
UNSEEN = 0.02
UNKNOWN = "und"
_SPACE = np.uint32(32)


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def trigrams(text: str, bits: int = BITS) -> np.ndarray:
    """Hashed trigrams of the lower-cased letters; all else counts as one space."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    code = np.where(_letters()[code], code, _SPACE)
    kept = code != _SPACE
    if not kept.any():
        return np.empty(0, dtype=np.int64)
    kept[1:] |= kept[:-1]
    code = np.concatenate(([_SPACE], code[kept], [_SPACE])).astype(np.uint32)
    mixed = code[:-2] * np.uint32(0x9E3779B1) ^ code[1:-1] * np.uint32(0x85EBCA77) ^ code[2:] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x27D4EB2F)
    return (mixed >> np.uint32(32 - bits)).astype(np.int64)


def trigram_counts(df: DataFrame, bits: int = BITS) -> DataFrame:
    """(lang, gram, n) over all rows of (text, lang); each task emits its sums once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                own = sums.setdefault(lang, np.zeros(1 << bits, dtype=np.int64))
                own += np.bincount(trigrams(text, bits), minlength=1 << bits)
        for lang, own in sums.items():
            seen = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(own[seen])],
                                             names=["lang", "gram", "n"])

    found = with_package(df).mapInArrow(lambda batches: count(slices(batches)), "lang string, gram int, n long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class LanguageModel:
    """Log-probabilities of the hashed trigrams, one column per language, the last for noise."""

    def __init__(self, languages: list[str], log_p: np.ndarray, bits: int):
        self.languages, self.log_p, self.bits = languages, log_p, bits

    @classmethod
    def fit(cls, df: DataFrame, bits: int = BITS) -> LanguageModel:
        """From (text, lang); rows with null lang are left out, a null text has no trigrams."""
        rows = df.filter("lang IS NOT NULL AND text IS NOT NULL").select("text", F.col("lang").cast("string").alias("lang"))
        table = trigram_counts(rows, bits).toArrow()  # at most languages x 2^bits rows
        languages = sorted(set(table.column("lang").to_pylist()))
        counts = np.zeros((1 << bits, len(languages) + 1))
        place = {lang: at for at, lang in enumerate(languages)}
        columns = np.fromiter((place[lang] for lang in table.column("lang").to_pylist()), dtype=np.int64, count=len(table))
        counts[table.column("gram").to_numpy(), columns] = table.column("n").to_numpy()
        seen = counts / np.maximum(counts.sum(axis=0), 1)
        return cls(languages, np.log((1 - UNSEEN) * seen + np.where(counts.sum(axis=0) > 0, UNSEEN, 1.0) / (1 << bits)).astype(np.float32), bits)

    def _shares(self, p: np.ndarray, weights: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
        """Shares of the columns of ``p`` by expectation-maximisation, and the log-likelihood."""
        shares, total = start, weights.sum()
        for _ in range(ROUNDS):
            mixed = p @ shares
            shares = shares * ((weights / mixed) @ p) / total
        return shares, float(weights @ np.log(p @ shares + 1e-30))

    def mixture(self, text: str) -> tuple[list[tuple[str, float]], float]:
        """Selected languages with their shares, largest first, and the share of noise."""
        found = trigrams(text, self.bits)
        if not len(found) or not self.languages:
            return [], 1.0
        counts = np.bincount(found, minlength=1 << self.bits)
        seen = np.flatnonzero(counts)
        weights = counts[seen] * TEMPER
        log_p = self.log_p[seen]
        p = np.exp(log_p - log_p.max(axis=1, keepdims=True)).astype(np.float64)
        noise = len(self.languages)
        alone = weights @ log_p[:, :noise]
        shares, _ = self._shares(p, weights, np.full(noise + 1, 1 / (noise + 1)))
        chosen = [int(np.argmax(alone)), noise]
        own, likelihood = self._shares(p[:, chosen], weights, np.array([0.9, 0.1]))
        penalty = PENALTY * np.log(len(found) + 1)
        while len(chosen) <= noise:
            rest = [at for at in range(noise) if at not in chosen]
            joining = max(rest, key=lambda at: shares[at])
            if shares[joining] < 1e-3:
                break
            trial = [joining, *chosen]
            start = np.append(max(shares[joining], 0.05), own * (1 - max(shares[joining], 0.05)))
            own_trial, likelihood_trial = self._shares(p[:, trial], weights, start)
            if likelihood_trial - likelihood <= penalty:
                break
            chosen, own, likelihood = trial, own_trial, likelihood_trial
        parts = sorted(((self.languages[at], float(share)) for at, share in zip(chosen, own, strict=True) if at != noise), key=lambda x: (-x[1], x[0]))
        return parts, float(own[chosen.index(noise)])


def identify(df: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score, noise, languages) of every row: the language with the largest
    share, that share without noise (0 to 1), the share of noise, and all selected languages
    with shares, largest first.

    Texts that are null or have no letter are ``und`` with score 0 and noise 1, and so is every
    text if there was nothing to learn from.  Other columns are ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # languages x 2^bits numbers

    def label(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [shared.value.mixture(text) for text in batch.column("text").to_pylist()]
        best = [max(0.0, min(1.0, parts[0][1] / max(1e-12, 1 - noise))) if parts else 0.0 for parts, noise in found]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([parts[0][0] if parts else UNKNOWN for parts, _ in found]), pa.array(best, pa.float64()),
             pa.array([noise for _, noise in found], pa.float64()),
             pa.array([",".join(f"{lang}:{share:.3f}" for lang, share in parts) for parts, _ in found])],
            names=["doc_id", "lang_pred", "score", "noise", "languages"])

    return in_batches(texts(df), label, "doc_id long, lang_pred string, score double, noise double, languages string")


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id's text divisible by 5."""
    return remainder(doc_id, 5) == 0


def identify_documents(df: DataFrame) -> DataFrame:
    """Learn from the rows of ``df`` that are not held out, then label all of them."""
    model = LanguageModel.fit(df.filter(~held_out(F.col("doc_id"))))
    return identify(df, model).withColumn("held_out", held_out(F.col("doc_id")))


def known_language(df: DataFrame, most_noise: float = 0.5) -> DataFrame:
    """Rows of ``df`` in a learned language: no ``und``, and noise is not the larger part.

    The label is found beside the row's own columns, so no text is shuffled.
    """
    model = LanguageModel.fit(df.filter(~held_out(F.col("doc_id"))))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def keep(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [shared.value.mixture(text or "") for text in batch.column("text").to_pylist()]
        yield batch.filter(pa.array([bool(parts) and noise <= most_noise for parts, noise in found], pa.bool_()))

    return in_batches(df, keep, df.schema)
