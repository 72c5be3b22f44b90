"""Benchmark decontamination: BM25 with block-max WAND, then a check of question and answer.

Test items are indexed; every passage of every document is a query. Passages are windows of
``2 * STRIDE`` words that start every ``STRIDE`` words, so every word is in two. An item's
score is divided by what it scores against itself: 1 when the passage has all its words. All
items at or above ``threshold`` are retrieved, however many. Long items are indexed in parts
of at most ``PART`` words.

As the threshold is fixed, WAND needs no heap: a part can be skipped as soon as the largest
contributions of the passage's words cannot reach the threshold. Of each part only the rarest
words are posted, so many that what is left can give at most ``SLACK``. Posting lists go by
blocks of ``BLOCK`` parts and hold the largest contribution in the block. The bounds of a
passage are the sums over its words, plus what the block's parts hold back; blocks whose
bound stays below the threshold are skipped, the parts of the others scored in full.

A retrieved item is kept if the text around the passage holds at least ``overlap`` of the
five-word shingles of its question and of its answer. The answer is the last sentences with
five words or more, the question what stands before; an item too short for both is checked as
a whole.

Number of parts, mean length and document frequency of words are those of the whole
benchmark, computed in Spark. Parts are dealt to indexes of about ``PASS_PARTS`` parts by a
hash, and each is built in a task and written out. The documents are read once for every
index, which the driver loads and broadcasts one at a time; so an index bounds what driver and
tasks hold, and how many there are changes no result. Documents are never shuffled.

Cases: null texts and items, and items without words, match nothing; repeated documents match
alike, repeated items each for themselves, an item without id under a null id; case and ASCII
punctuation do not count; an empty table on either side gives no rows.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pagecatalog.session import materialize

STRIDE = 32
THRESHOLD = 0.5
OVERLAP = 0.5
SHINGLE = 5
PART = 64
BLOCK = 8
PASS_PARTS = 20_000
SLACK = 0.3
K1, B = 1.2, 0.75
_BATCH_WORDS = 200_000
_CELLS = 1 << 22  # of a table of bounds
_ROUNDING = 1e-9

_PLAIN = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def shingles(words: list[bytes]) -> list[bytes]:
    if not words:
        return []
    return [b" ".join(words[i:i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))]


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    sentences = [s for s in map(words_of, re.split(r"[.!?\n]+", text)) if s]
    answer: list[bytes] = []
    while sentences and len(answer) < SHINGLE:
        answer = sentences.pop() + answer
    question = [w for s in sentences for w in s]
    if len(question) < SHINGLE:
        question = answer = question + answer
    return question, answer


def contribution(times: int, spread: int, size: int, parts: int, mean: float) -> float:
    """BM25 of a word that is ``times`` in a part of ``size`` words and in ``spread`` of all parts."""
    return math.log(1 + (parts - spread + 0.5) / (spread + 0.5)) * times * (K1 + 1) / (times + K1 * (1 - B + B * size / mean))


def parts_of(text: str | None) -> list[list[bytes]]:
    words = words_of(text)
    n = -(-len(words) // PART)
    return [words[i * len(words) // n:(i + 1) * len(words) // n] for i in range(n)]


@dataclass
class Index:
    """Posting lists of a few thousand parts, and what their items are checked by."""

    vocabulary: dict[bytes, int]
    owner: np.ndarray  # of each part, its item
    part_at: np.ndarray  # where each part's words begin
    part_word: np.ndarray
    part_weight: np.ndarray
    list_at: np.ndarray  # where each word's posting list begins
    list_block: np.ndarray
    list_ceiling: np.ndarray  # largest contribution of the word in the block
    held: np.ndarray  # per block: what the words that are not posted can add
    checks: list[tuple[int | None, set, set, int]]  # item id, shingles of question and answer, words


def index_of(items: list[tuple[int | None, str]], owner: list[int], parts: list[list[tuple[bytes, float]]]) -> Index:
    """``parts`` holds each part's words, in order, with their contributions, ``owner`` the number of
    its item. Scores add up in the order of words, so they do not depend on the other parts."""
    checks = []
    for item_id, text in items:
        question, answer = question_and_answer(text)
        checks.append((item_id, set(shingles(question)), set(shingles(answer)), len(words_of(text))))
    spread = Counter(word for p in parts for word, _ in p)
    vocabulary = {word: i for i, word in enumerate(sorted(spread))}
    rarity = np.array([spread[w] for w in vocabulary], np.int64)
    ids, weights, posted, held = [], [], [], []
    for p in parts:
        word = np.array([vocabulary[w] for w, _ in p], np.int64)
        weight = np.array([x for _, x in p])
        weight /= weight.sum()
        rarest = np.argsort(rarity[word], kind="stable")
        left = 1 - np.cumsum(weight[rarest])  # of the words after each
        last = int(np.argmax(left <= SLACK + _ROUNDING))
        ids.append(word)
        weights.append(weight)
        posted.append(np.isin(np.arange(len(word)), rarest[:last + 1]))
        held.append(max(0.0, left[last]))
    sizes = np.array([len(x) for x in ids], np.int64)
    part_word, part_weight, is_posted = np.concatenate(ids), np.concatenate(weights), np.concatenate(posted)
    number = np.repeat(np.arange(len(parts)), sizes)
    key = part_word[is_posted] * len(parts) + number[is_posted] // BLOCK
    entry, at = np.unique(key, return_inverse=True)
    ceiling = np.zeros(len(entry))
    np.maximum.at(ceiling, at, part_weight[is_posted])
    blocks = -(-len(parts) // BLOCK)
    most = np.zeros(blocks * BLOCK)
    most[:len(parts)] = held
    return Index(vocabulary, np.array(owner, np.int64), np.concatenate([[0], np.cumsum(sizes)]), part_word, part_weight,
                 np.searchsorted(entry // len(parts), np.arange(len(vocabulary) + 1)), entry % len(parts), ceiling,
                 most.reshape(blocks, BLOCK).max(axis=1), checks)


def spread_out(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(owner, place)`` of all elements of ranges that begin at ``starts``."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes - starts, sizes)


def retrieve(index: Index, documents: list[list[bytes]], threshold: float) -> Iterator[tuple[int, int, int, float]]:
    """``(document, first word, part, score)`` for all passages that reach the threshold."""
    halves = np.array([-(-len(d) // STRIDE) for d in documents], np.int64)
    begin = np.cumsum(halves) - halves
    lengths = np.array([len(d) for d in documents], np.int64)
    owner, place = spread_out(np.zeros(len(documents), np.int64), lengths)
    word = np.fromiter((i for d in documents for i in map(index.vocabulary.get, d, repeat(-1))), np.int64, int(lengths.sum()))
    known = word >= 0
    words = len(index.vocabulary)
    said = np.unique((begin[owner[known]] + place[known] // STRIDE) * words + word[known])  # words of each half, once
    half, word = said // words, said % words
    total, blocks = int(halves.sum()), len(index.held)
    goes_on = np.ones(total, bool)  # a passage is a half and the next one
    goes_on[(begin + halves - 1)[halves > 0]] = False
    document = np.repeat(np.arange(len(documents)), halves)
    step = max(1, _CELLS // blocks)
    for low in range(0, total, step):
        rows = min(step, total - low) + 1
        a, b = np.searchsorted(half, [low, low + rows])
        sizes = index.list_at[word[a:b] + 1] - index.list_at[word[a:b]]
        of, at = spread_out(index.list_at[word[a:b]], sizes)
        bound = np.bincount((half[a:b][of] - low) * blocks + index.list_block[at], index.list_ceiling[at], rows * blocks).reshape(rows, blocks)
        bound[:-1][goes_on[low:low + rows - 1]] += bound[1:][goes_on[low:low + rows - 1]]
        passage, block = np.nonzero(bound[:-1] + index.held >= threshold - _ROUNDING)
        part = (block[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        passage = np.repeat(passage + low, BLOCK)[part < len(index.owner)]
        part = part[part < len(index.owner)]
        for i in range(0, len(part), _CELLS // PART):
            some, of_passage = part[i:i + _CELLS // PART], passage[i:i + _CELLS // PART]
            of, at = spread_out(index.part_at[some], index.part_at[some + 1] - index.part_at[some])
            wanted = of_passage[of] * words + index.part_word[at]
            here = _among(said, wanted)
            also = goes_on[of_passage[of]] & ~here
            here[also] = _among(said, wanted[also] + words)
            score = np.bincount(of, index.part_weight[at] * here, len(some))
            for k in np.flatnonzero(score >= threshold):
                d = int(document[of_passage[k]])
                yield d, int(of_passage[k] - begin[d]) * STRIDE, int(some[k]), float(score[k])


def _among(ordered: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(wanted), bool)
    return ordered[np.minimum(np.searchsorted(ordered, wanted), len(ordered) - 1)] == wanted


def matches(index: Index, documents: list[list[bytes]], threshold: float, overlap: float) -> Iterator[tuple]:
    """``(document, item, score, question overlap, answer overlap)`` of what is kept."""
    best: dict[tuple[int, int], tuple] = {}
    for d, start, part, score in retrieve(index, documents, threshold):
        item = int(index.owner[part])
        _, question, answer, length = index.checks[item]
        around = documents[d][max(0, start - length):start + 2 * STRIDE + length]
        here = {b" ".join(around[i:i + n]) for n in {min(SHINGLE, length)} for i in range(len(around) - n + 1)}
        asked, answered = len(question & here) / len(question), len(answer & here) / len(answer)
        if asked >= overlap and answered >= overlap:
            row = (score, asked, answered)
            best[d, item] = tuple(map(max, row, best[d, item])) if (d, item) in best else row
    for (d, item), row in best.items():
        yield d, item, *row


def indexes(benchmark: DataFrame, pass_parts: int = PASS_PARTS) -> DataFrame:
    """``(pass, index)``: all items of ``benchmark (item_id, text)``, as pickled indexes."""
    def words_in(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(uid, n, len(part), word, times) for uid, text in zip(batch["uid"], batch["text"])
                    for n, part in enumerate(parts_of(text)) for word, times in Counter(part).items()]
            yield pd.DataFrame(rows, columns=["uid", "part", "size", "word", "times"])

    items = materialize(benchmark.filter("text is not null").select(
        F.monotonically_increasing_id().alias("uid"), F.col("item_id").cast("bigint").alias("item_id"), "text"), "items")
    said = materialize(items.select("uid", "text").mapInPandas(
        words_in, "uid bigint, part int, size int, word binary, times int"), "item-words")
    whole = said.groupBy("uid", "part").agg(F.first("size").alias("size")).agg(
        F.count("*").alias("parts"), F.avg("size").alias("mean")).first()
    parts, mean = whole["parts"], float(whole["mean"] or 1)
    passes = max(1, -(-parts // pass_parts))
    spread = said.groupBy("word").agg(F.count("*").alias("spread"))
    listed = said.join(spread, "word").groupBy("uid", "part", "size").agg(F.collect_list(F.struct("word", "times", "spread")).alias("words"))
    dealt = listed.withColumn("pass", F.pmod(F.xxhash64("uid", "part"), F.lit(passes)).cast("int")).join(items, "uid")

    def built(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["uid", "part"])
        first = rows.drop_duplicates("uid")
        number = {uid: i for i, uid in enumerate(first["uid"])}
        weighted = [sorted((bytes(w["word"]), contribution(w["times"], w["spread"], size, parts, mean)) for w in words)
                    for size, words in zip(rows["size"], rows["words"])]
        index = index_of([(None if pd.isna(i) else int(i), t) for i, t in zip(first["item_id"], first["text"])],
                         [number[u] for u in rows["uid"]], weighted)
        return pd.DataFrame({"pass": [key[0]], "uids": [first["uid"].to_numpy()], "index": [pickle.dumps(vars(index))]})

    return materialize(dealt.groupBy("pass").applyInPandas(built, "pass int, uids array<bigint>, index binary"), "indexes")


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP,
          pass_parts: int = PASS_PARTS) -> DataFrame:
    """``(doc_id, rid, th, item_id, score, question_overlap, answer_overlap)``: one row per row of
    ``docs (doc_id, rid, th, text)`` and item of ``benchmark (item_id, text)`` that it leaks."""
    schema = ("doc_id bigint, rid bigint, th bigint, nth bigint, uid bigint, item_id bigint, score double, "
              "question_overlap double, answer_overlap double")
    built = indexes(benchmark, pass_parts)
    # a row's place in the scan tells repeated rows apart where several indexes find the same item
    rows = docs.select("doc_id", "rid", "th", "text", F.monotonically_increasing_id().alias("nth"))
    found = []
    for number in sorted(r["pass"] for r in built.select("pass").collect()):
        one = built.filter(F.col("pass") == number).first()
        pickled, uids = bytes(one["index"]), one["uids"]

        def of(batches: Iterator[pd.DataFrame], pickled=pickled, uids=uids) -> Iterator[pd.DataFrame]:
            index = Index(**pickle.loads(pickled))

            def solved(held: list[tuple]) -> pd.DataFrame:
                out = [(*held[d][:4], uids[item], index.checks[item][0], *row)
                       for d, item, *row in matches(index, [h[4] for h in held], threshold, overlap)]
                names = ["doc_id", "rid", "th", "nth", "uid", "item_id", "score", "question_overlap", "answer_overlap"]
                return pd.DataFrame(out, columns=names).astype({"doc_id": "Int64", "item_id": "Int64"})

            held, size = [], 0
            for batch in batches:
                for *row, text in zip(*(batch[c] for c in ("doc_id", "rid", "th", "nth", "text"))):
                    held.append((*row, words_of(text)))
                    size += len(held[-1][4])
                    if size >= _BATCH_WORDS:
                        yield solved(held)
                        held, size = [], 0
            if held:
                yield solved(held)

        found.append(materialize(rows.mapInPandas(of, schema), "leaks"))
    if not found:
        return rows.filter("false").mapInPandas(lambda batches: iter(()), schema).drop("nth", "uid")
    best = [F.max(c).alias(c) for c in ("score", "question_overlap", "answer_overlap")]
    return reduce(DataFrame.union, found).groupBy("doc_id", "rid", "th", "nth", "uid", "item_id").agg(*best).drop("nth", "uid")
