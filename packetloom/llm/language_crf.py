"""Language ID of words and documents with a linear-chain conditional random field.

A word's features are its character n-grams with marks at both ends (so that they hold its
affixes too) and the word itself as a lexicon entry, hashed into a table of weights per
language. Sentences are chains with learned transitions; training joins halves of sentences
of different documents, so that switches are learned as well. Words are labelled by
forward-backward, and a document's language is the one with the largest mean probability.

The model is fitted on a bounded sample of labelled rows on the driver and is applied to
whole texts in Arrow batches; all chains of a batch advance together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from packetloom.llm.common import table, unused

#: Labelled documents per language that the model is fitted on: the bound of the training sample.
PER_LANGUAGE = 100
#: log2 of the feature table; with float32 weights it takes 4 bytes x languages for each entry.
BITS = 17
GRAMS = (1, 2, 3, 4)
ROUNDS, RATE, SHRINK = 20, 0.3, 1e-4
#: Text handled at once in a task; a word takes some 150 bytes meanwhile.
CHUNK = 1_000_000
#: The pipeline rejects documents with no language, or whose words have on average a probability in their own best
#: language under LEAST; with more than four languages, under CHANCE times what guessing gives.
LEAST = 0.4
CHANCE = 1.6
UNKNOWN = "und"

_MIX = np.uint64(0x9E3779B97F4A7C15)
_LINE = "\x1e"


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def features(words: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids of all words one after the other, and where each word's begin."""
    points = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    starts = np.cumsum(sizes) - sizes
    word = np.repeat(np.arange(len(words)), sizes)
    found, owner = [], []
    for n in GRAMS:
        h = np.full(max(len(points) - n + 1, 0), n, np.uint64)
        for k in range(n):
            h = (h ^ points[k:k + len(h)]) * _MIX
            h ^= h >> np.uint64(29)
        inside = word[:len(h)] == word[n - 1:n - 1 + len(h)]
        found.append(h[inside])
        owner.append(word[:len(h)][inside])
    place = np.arange(len(points)) - starts[word]
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(sizes.max(initial=1), _MIX, np.uint64))
    found.append(np.add.reduceat((points + np.uint64(7)) * powers[place], starts) if len(words) else points)
    owner.append(np.arange(len(words)))
    found, owner = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    ids = ((found[order] * _MIX) >> np.uint64(64 - bits)).astype(np.int64)
    return ids, np.searchsorted(owner[order], np.arange(len(words)))


def tokens(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """Word ids, the different words, the text of each word, and whether a word begins a chain.

    Chains are sentences: they end at a line's end and after . ! or ?
    """
    plain = pc.replace_substring(pc.utf8_lower(pc.fill_null(texts, "")), "\n", f" {_LINE} ")
    split = pc.ascii_split_whitespace(plain)
    flat = split.flatten()
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    coded = flat.dictionary_encode()
    ids, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
    breaks = np.array([w == _LINE for w in words] or [], bool)
    ends = np.array([w[-1:] in (".", "!", "?") for w in words] or [], bool)
    real = np.array([w not in ("", _LINE) for w in words] or [], bool)
    if not len(ids):
        return ids, words, text, np.zeros(0, bool)
    after = np.concatenate([[True], breaks[ids[:-1]] | ends[ids[:-1]] | (text[1:] != text[:-1])])
    group = np.cumsum(after)
    kept = real[ids]
    ids, text, group = ids[kept], text[kept], group[kept]
    return ids, words, text, np.concatenate([[True], group[1:] != group[:-1]])[:len(ids)]


def chances(scores: np.ndarray, begins: np.ndarray, jumps: np.ndarray) -> tuple[np.ndarray, ...]:
    """Forward-backward: probability of each label at each word; what it is made of (local, ahead, back, move).

    scores: one row per word; begins: whether it begins a chain; jumps: transition scores.
    """
    n, labels = scores.shape
    local = scores - scores.max(1, keepdims=True)
    np.exp(local, out=local)
    move = np.exp(jumps - jumps.max()).astype(scores.dtype)
    first = np.flatnonzero(begins)
    size = np.diff(np.append(first, n))
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    alive = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right") if n else []
    ahead, back = np.empty_like(local), np.ones_like(local)
    for t, k in enumerate(alive):
        at = first[:k] + t
        a = local[at] if not t else local[at] * (ahead[at - 1] @ move)
        ahead[at] = a / a.sum(1, keepdims=True)
    for t in range(len(alive) - 1, 0, -1):
        at = first[:alive[t]] + t
        b = (local[at] * back[at]) @ move.T
        back[at - 1] = b / b.sum(1, keepdims=True)
    both = ahead * back
    both /= both.sum(1, keepdims=True)
    return both, local, ahead, back, move


def marginals(scores: np.ndarray, begins: np.ndarray, jumps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each label at each word, and of each transition in sum."""
    both, local, ahead, back, move = chances(scores, begins, jumps)
    inner = np.flatnonzero(~begins)
    left, right = ahead[inner - 1], local[inner] * back[inner]
    weight = np.einsum("ni,ij,nj->n", left, move, right, optimize=True)
    pairs = move * ((left / weight[:, None]).T @ right) if len(inner) else np.zeros_like(move)
    return both, pairs


@dataclass
class LanguageModel:
    labels: list[str]
    weights: np.ndarray  # feature x label
    jumps: np.ndarray  # label x label

    def scores(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, len(self.labels)), np.float32)
        ids, starts = features(words, int(np.log2(len(self.weights))))
        return np.add.reduceat(self.weights[ids], starts, axis=0)


def fit(texts: list[str], labels: list[str], bits: int = BITS, rounds: int = ROUNDS) -> LanguageModel:
    """Maximise the conditional likelihood of the labels of all words, by adaptive gradient steps."""
    names = sorted(set(labels))
    if not names:
        return LanguageModel([], np.zeros((2, 0), np.float32), np.zeros((0, 0)))
    ids, words, text, begins = tokens(pa.array(texts, pa.string()))
    truth = np.array([names.index(x) for x in labels])[text]
    # second halves of the sentences change places, which makes code-switched chains
    group = np.cumsum(begins) - 1
    size = np.bincount(group)
    place = np.arange(len(ids)) - np.flatnonzero(begins)[group]
    other = np.random.default_rng(7).permutation(len(size))
    chain = np.where(place < (size[group] + 1) // 2, group, other[group])
    order = np.lexsort((place, chain != group, chain))
    ids, truth, chain = ids[order], truth[order], chain[order]
    begins = np.concatenate([[True], chain[1:] != chain[:-1]])

    parts = [features(words[a:a + 20_000], bits) for a in range(0, len(words), 20_000)]
    per_word = np.concatenate([np.diff(np.append(begin, len(found))) for found, begin in parts])
    feats = np.concatenate([found.astype(np.int32) for found, _ in parts])
    starts = np.cumsum(per_word) - per_word
    del parts
    k, v = len(names), len(words)
    right = np.zeros((len(ids), k), np.float32)
    right[np.arange(len(ids)), truth] = 1
    inner = np.flatnonzero(~begins)
    seen = np.zeros((k, k))
    np.add.at(seen, (truth[inner - 1], truth[inner]), 1)
    # one row of weights per label: the driver holds one label's features at a time
    weights, jumps = np.zeros((k, 1 << bits), np.float32), np.zeros((k, k))
    size_w, size_j = np.full_like(weights, 1e-8), np.full_like(jumps, 1e-8)
    for _ in range(rounds):
        scores = np.stack([np.add.reduceat(weights[j][feats], starts) for j in range(k)], 1)[ids]
        likely, pairs = marginals(scores, begins, jumps)
        miss = right - likely
        for j in range(k):
            by_word = np.bincount(ids, miss[:, j], v).astype(np.float32)
            slope = np.bincount(feats, np.repeat(by_word, per_word), 1 << bits) - SHRINK * len(ids) * weights[j]
            size_w[j] += slope ** 2
            weights[j] += RATE * slope / np.sqrt(size_w[j])
        step = seen - pairs
        size_j += step ** 2
        jumps += RATE * step / np.sqrt(size_j)
    return LanguageModel(names, np.ascontiguousarray(weights.T), jumps.astype(np.float32))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Fit on at most per_language documents of each language, none of them held out."""
    pick = Window.partitionBy("lang").orderBy("turn", "text")
    rows = docs.select("doc_id", "lang", "text").filter(
        ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.withColumn("turn", F.xxhash64("doc_id")).withColumn("k", F.row_number().over(pick))
    found = rows.filter(F.col("k") <= per_language).select("lang", "text").orderBy("lang", "text").collect()
    return fit([r.text for r in found], [r.lang for r in found])


def _judge(model: LanguageModel, texts: pa.Array, spans: bool):
    """(language, score, certainty of the words, spans) of each text."""
    n, k = len(texts), len(model.labels)
    ids, words, text, begins = tokens(texts)
    letters = pc.match_substring_regex(pa.array(words, pa.string()), r"\pL").to_numpy(zero_copy_only=False).astype(bool)
    if not len(ids) or not k:
        return [UNKNOWN] * n, np.zeros(n), np.zeros(n), [[] for _ in range(n)]
    likely = chances(model.scores(words)[ids], begins, model.jumps)[0]  # no transitions, which take as much again
    counted = letters[ids]
    total = np.stack([np.bincount(text[counted], likely[counted, j], n) for j in range(k)], 1)
    size = np.bincount(text[counted], minlength=n)
    mean = total / np.maximum(size, 1)[:, None]
    sure = np.bincount(text[counted], likely[counted].max(1), n) / np.maximum(size, 1)
    best = mean.argmax(1)
    said = [model.labels[b] if s else UNKNOWN for b, s in zip(best, size, strict=True)]
    runs: list[list] = [[] for _ in range(n)]
    if spans:
        label = np.where(counted, likely.argmax(1), k)
        turn = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (label[1:] != label[:-1])]))
        for a, b in zip(turn, np.append(turn[1:], len(ids)), strict=True):
            lang = UNKNOWN if label[a] == k else model.labels[label[a]]
            runs[text[a]].append({"lang": lang, "words": int(b - a)})
    return said, np.clip(mean[np.arange(n), best], 0, 1) * (size > 0), np.clip(sure, 0, 1), runs


def identify(docs: DataFrame, model: LanguageModel, names: tuple[str, ...], by_word: bool = False) -> DataFrame:
    """Adds columns to every row of docs, which has a text, under two or three names.

    The first is a language of the model, or und with score 0 if the text is null or has no letter;
    the second the mean probability of that language over the words that have a letter, or, by word,
    of each word's own best language; the
    third the runs of words of one language, in order. Other columns stay as they are.
    """
    spans = len(names) > 2
    model = docs.sparkSession.sparkContext.broadcast(model)  # features x languages, of fixed size

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            bytes_to = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False))
            cuts = np.searchsorted(bytes_to, np.arange(CHUNK, (bytes_to[-1] if len(bytes_to) else 0) + CHUNK, CHUNK), "right")
            at = 0
            for end in np.unique(np.append(cuts, len(text))).tolist():
                end = max(end, at + 1)
                if at >= len(text):
                    break
                part = batch.slice(at, end - at)
                said, score, sure, runs = _judge(model.value, part.column("text"), spans)
                more = [pa.array(said, pa.string()), pa.array(sure if by_word else score, pa.float64())]
                if spans:
                    more.append(pa.array(runs, pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64())]))))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *more], [*part.schema.names, *names])
                at = end

    schema = StructType(docs.schema.fields[:]).add(names[0], "string").add(names[1], "double")
    if spans:
        run = StructType().add("lang", "string").add("words", "long")
        schema = schema.add(names[2], ArrayType(run))
    return docs.mapInArrow(label, schema)


def language_id(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Language of every document (doc_id, text, lang): doc_id, held_out, lang_pred, score, spans.

    Learns from rows with a lang that are not held out; with none of these all is und. A null doc_id
    is not held out. Repeated rows are judged each; an empty table gives no rows; other columns
    are not looked at.
    """
    out = identify(docs.select("doc_id", "text"), train(docs, per_language), ("lang_pred", "score", "spans"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "spans")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents")).drop("spans")


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents of a known language, in the columns they came with."""
    lang, score = unused(docs, "lang_pred"), unused(docs, "lang_score")
    model = train(docs)
    least = min(LEAST, CHANCE / max(len(model.labels), 1))
    found = identify(docs, model, (lang, score), by_word=True)
    return found.filter((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).drop(lang, score)
