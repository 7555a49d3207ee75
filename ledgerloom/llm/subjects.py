"""Subject areas of documents.

1. Each text becomes sentences of hashed words; words are weighted by how few texts of the same language have them,
   projected to DIM dimensions and normalised. Bisecting k-means on all of these document vectors (see `bisecting`)
   gives the leaves, and every document is put into its nearest leaf.
2. The words that a leaf's documents have more often than their language are its discriminative terms. Leaves are
   labelled by the hand labels that fall on them and on leaves of like terms, and by words of like spelling in leaves
   of other languages; a label whose leaves do not hold most of what the leaf's terms say is taken back.
3. A text is a mixture of leaves: each of its sentences goes to the leaf for whose terms it speaks most, or to none.
   The parts of the leaves of one label are added up, so a text can have several subjects. Leaves without a label
   (texts about nothing in particular, figures of speech) take part, so that their sentences go to no subject.

Nothing rests on a sample: document frequencies, leaves, the words that tell, terms and mixtures are of all documents.
What reaches the driver is bounded: counts per language and hashed word, sums of leaves, TERMS terms of each leaf.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from ledgerloom.llm import bisecting
from ledgerloom.llm.bisecting import _unit, bisected, raw, whole  # noqa: F401
from ledgerloom.llm.sentences import LANGUAGES, language, sentences, words
from ledgerloom.runtime import Scratch, slices

#: Words are hashed to so many buckets: with v words in use a word shares its bucket with chance 1 - exp(-v / BUCKETS).
BUCKETS = 1 << 20
DIM = 128
LEAVES = 192
#: Texts of a language that must have a word for it to count.
LEAST_TEXTS = 3
#: Words in more than this part of a language's texts, divided by the number of areas, say nothing about a subject
#: unless their relative entropy over leaves (nats) is above UNEVEN.
COMMON = 1.2
UNEVEN = 0.25
#: Discriminative terms per leaf, and of these the ones that leaves are compared by.
TERMS, COMPARED = 300, 40
#: Part of a text that a label is taken to have when a word's rate in its leaves is weighed against the rate outside.
EVEN = 0.1
#: A term has to be about twice as frequent in a leaf as outside (nats), and a sentence speaks for a leaf with a score
#: that one clear term (at most -log(EVEN) = 2.3) or two weaker ones give.
LEAST_LIFT, LEAST_SCORE = 0.7, 1.5
#: Least part of a text's sentences.
SHARE = 0.3
L = len(LANGUAGES)
#: Weight of the language against the words in a vector: leaves part by language first.
LANGUAGE_WEIGHT = 1.5
#: A text without function words is taken for the likeliest language if that has at least this part of its words.
KNOWN_WORDS = 0.5


def _bucket(word: str) -> int:
    return zlib.crc32(word.encode()) & (BUCKETS - 1)


#: Words that a task remembers; then it forgets them all and reports the words that come after anew.
REMEMBERED = 300_000


class _Buckets(dict):
    """word -> bucket; fresh holds the words met for the first time since the last clearing."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        i = self[word] = _bucket(word)
        self.fresh.append(word)
        return i


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, terms (distinct buckets of each sentence, uint32), sizes (their number, int32), fresh (words first met)."""
    known = _Buckets()
    for b in slices(batches, "text"):
        langs, terms, sizes, fresh = [], [], [], []
        for text in b.column("text").to_pylist():
            found = [w for w in map(words, sentences(text)) if w]
            ids = [{known[w] for w in ws} for ws in found]
            fresh.append(known.fresh)
            known.fresh = []
            if len(known) > REMEMBERED:
                known.clear()
            langs.append(language(found))
            sizes.append(array("i", map(len, ids)).tobytes())
            terms.append(array("I", chain.from_iterable(ids)).tobytes())
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(langs, pa.int32()), pa.array(terms, pa.binary()), pa.array(sizes, pa.binary()), pa.array(fresh, pa.list_(pa.string()))], names=["id", "lang", "terms", "sizes", "fresh"])


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial document frequencies of each language and bucket; bucket -1 counts the language's documents."""
    df: dict[int, np.ndarray] = {}
    docs = np.zeros(L, np.int64)
    for b in slices(batches, "terms"):
        doc, terms, _, _ = _flat(b)
        langs = np.asarray(b.column("lang").to_pylist(), np.int64)
        docs += np.bincount(langs, minlength=L)
        cell = np.unique(doc * BUCKETS + terms)
        of = langs[cell // BUCKETS]
        for g in np.unique(of):
            t, n = np.unique(cell[of == g] % BUCKETS, return_counts=True)
            df.setdefault(int(g), np.zeros(BUCKETS, np.int32))[t] += n.astype(np.int32)
    for g, n in df.items():
        t = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), g, np.int32)), pa.array(t.astype(np.int32)), pa.array(n[t].astype(np.int64))], names=["lang", "term", "n"])
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(L, dtype=np.int32)), pa.array(np.full(L, -1, np.int32)), pa.array(docs)], names=["lang", "term", "n"])


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc (of each term), terms, sentence sizes, sentences per document of a batch."""
    raw = b.column("terms").to_pylist()
    doc = np.repeat(np.arange(len(raw)), [len(x) // 4 for x in raw])
    sizes = b.column("sizes").to_pylist()
    return doc, np.frombuffer(b"".join(raw), np.uint32).astype(np.int64), np.frombuffer(b"".join(sizes), np.int32).astype(np.int64), np.array([len(x) // 4 for x in sizes])


@dataclass
class Words:
    """The words in use (those of LEAST_TEXTS texts of some language): buckets, texts by language, and what tells."""

    used: np.ndarray
    df: np.ndarray
    n_docs: np.ndarray
    telling: np.ndarray

    def __post_init__(self):
        self.size = len(self.used)
        self.place = np.full(BUCKETS, -1, np.int32)
        self.place[self.used] = np.arange(self.size)

    def common(self) -> np.ndarray:
        """Words of enough texts that do not tell in a language."""
        return (self.df >= LEAST_TEXTS) & ~self.telling

    def cells(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """langs of the documents; doc, term, n: how many sentences of a document have a word in use."""
        doc, terms, _, _ = _flat(b)
        terms = self.place[terms]
        on = terms >= 0
        cell, n = np.unique(doc[on] * max(self.size, 1) + terms[on], return_counts=True)
        doc, terms = np.divmod(cell, max(self.size, 1))
        return self.languages(b.column("lang").to_pylist(), doc, terms), doc, terms, n

    def languages(self, langs: list[int], doc: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """The languages, with the likeliest for texts of unknown language whose words it has."""
        langs = np.array(langs, np.int64)
        if not (langs == L - 1).any():
            return langs
        likely = np.log((self.df[:-1] + 0.5) / (self.n_docs[:-1, None] + 1))
        for i in np.flatnonzero(langs == L - 1):
            t = terms[doc == i]
            best = likely[:, t].sum(1).argmax()
            if len(t) and (self.df[best, t] > 0).mean() >= KNOWN_WORDS:
                langs[i] = best
        return langs

    def vectors(self, langs: np.ndarray, doc: np.ndarray, terms: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Normalised document vectors: weighted words projected by hashing, and the language."""
        idf = np.where(self.telling, np.log(np.maximum(self.n_docs[:, None], 1) / np.maximum(self.df, 1)), 0.0)
        w = idf[langs[doc], terms]
        on = w > 0
        doc, terms, x = doc[on], terms[on], (1 + np.log(n[on])) * w[on] ** 2
        dims, signs = _projection(self.used)
        v = np.zeros((len(langs), DIM + L))
        v[:, :DIM] = np.bincount((doc[:, None] * DIM + dims[terms]).ravel(), (signs[terms] * x[:, None]).ravel(), len(langs) * DIM).reshape(-1, DIM)
        v = _unit(v)
        v[np.arange(len(langs)), DIM + langs] = LANGUAGE_WEIGHT
        return _unit(v).astype(np.float32)


def _projection(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eight dimensions and signs of each bucket, by a hash of its number."""
    x = buckets.astype(np.uint64)[:, None] * np.uint64(8) + np.arange(8, dtype=np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(factor)
        x ^= x >> np.uint64(shift)
    return (x >> np.uint64(8)).astype(np.int64) % DIM, np.where(x & np.uint64(1), 1.0, -1.0)


def _vectors(shared):
    """id, v: the vectors of the documents in whole numbers; lang; cells: how many words in use a document has, and
    common: those that are common in its language and do not tell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w: Words = shared.value
        asked = w.common()
        for b in slices(batches, "terms"):
            langs, doc, terms, n = w.cells(b)
            v = whole(w.vectors(langs, doc, terms, n))
            on = asked[langs[doc], terms]
            common = terms[on].astype(np.int32)
            ends = np.searchsorted(doc[on], np.arange(len(langs) + 1))
            own = [common[a:z].tobytes() for a, z in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([x.tobytes() for x in v], pa.binary()), pa.array(langs.astype(np.int32)), pa.array(np.bincount(doc, minlength=len(langs)).astype(np.int32)), pa.array(own, pa.binary())], names=["id", "v", "lang", "cells", "common"])

    return run


def _spread(centres: np.ndarray):
    """lang, leaf, term, n: partial counts of the documents with a common word; term -1 counts the words in use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centres.astype(np.float64).T
        for b in slices(batches, "v"):
            if not b.num_rows:
                continue
            leaf = (raw(b.column("v"), np.int32).reshape(b.num_rows, -1).astype(np.float64) @ c).argmax(1)
            of = b.column("lang").to_numpy().astype(np.int64) * len(centres) + leaf
            many = pc.binary_length(b.column("common")).to_numpy() // 4
            cell, n = np.unique(np.repeat(of, many) * BUCKETS + raw(b.column("common"), np.int32), return_counts=True)
            every = np.bincount(of, b.column("cells").to_numpy(), L * len(centres)).astype(np.int64)
            some = np.flatnonzero(every)
            of, term = np.divmod(cell, BUCKETS)
            of, term, n = np.concatenate([of, some]), np.concatenate([term, np.full(len(some), -1)]), np.concatenate([n, every[some]])
            yield pa.RecordBatch.from_arrays([pa.array((of // len(centres)).astype(np.int32)), pa.array((of % len(centres)).astype(np.int32)), pa.array(term.astype(np.int32)), pa.array(n.astype(np.int64))], names=["lang", "leaf", "term", "n"])

    return run


def _uneven(vectors: DataFrame, centres: np.ndarray, shape: tuple[int, int], scratch: Scratch) -> np.ndarray:
    """Which common words are spread over the leaves of their language unlike its words as a whole.

    Measured by the relative entropy of the two distributions over all documents, less what chance makes of it.
    """
    counts = scratch.save(vectors.mapInArrow(_spread(centres), "lang int, leaf int, term int, n bigint").groupBy("lang", "leaf", "term").agg(F.sum("n").alias("n")))
    q = counts.where("term < 0").select("lang", "leaf", (F.col("n") / F.sum("n").over(W.partitionBy("lang"))).alias("q"))
    each = counts.where("term >= 0").join(F.broadcast(q), ["lang", "leaf"]).groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.log(F.col("n") / F.col("q"))).alias("x"), F.count("*").alias("m"))
    d = F.col("x") / F.col("all") - F.log("all") - (F.col("m") - 1) / (2 * F.col("all"))
    found = each.where(d > UNEVEN).select("lang", "term").toPandas()
    scratch.drop(counts)
    out = np.zeros(shape, bool)
    out[found["lang"], found["term"]] = True
    return out


#: Distinct (leaf, word) pairs that a task holds before it hands on what it has counted.
HELD = 2_000_000


def _placed(shared):
    """Rows of two kinds: (id, leaf) of each document, and (leaf, term, n) partial counts of sentences with a term.

    Term -1 counts the words of a leaf's sentences, term -2 - lang its documents of a language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, centres = shared.value
        keys, counts = [], []
        lowest = L + 1
        width = w.size + lowest

        def merged() -> tuple[np.ndarray, np.ndarray]:
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            return key, np.bincount(at, np.concatenate(counts)).astype(np.int64)

        def handed(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            leaf, term = np.divmod(key, width)
            return pa.RecordBatch.from_arrays([pa.nulls(len(key), pa.int64()), pa.array(leaf.astype(np.int32)), pa.array((term - lowest).astype(np.int32)), pa.array(n)], names=["id", "leaf", "term", "n"])

        for b in slices(batches, "terms"):
            langs, doc, terms, n = w.cells(b)
            leaf = (w.vectors(langs, doc, terms, n) @ centres.T).argmax(1)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(leaf.astype(np.int32)), pa.nulls(len(leaf), pa.int32()), pa.nulls(len(leaf), pa.int64())], names=["id", "leaf", "term", "n"])
            every = [(leaf[doc] * width + terms + lowest, n), (leaf[doc] * width + lowest - 1, n), (leaf * width + lowest - 2 - langs, np.ones(len(leaf), np.int64))]
            for key, m in every:
                key, at = np.unique(key, return_inverse=True)
                keys.append(key)
                counts.append(np.bincount(at, m, len(key)))
            if sum(map(len, keys)) > HELD:
                key, n = merged()
                keys, counts = [key], [n]
                if len(key) > HELD // 2:
                    yield handed(key, n)
                    keys, counts = [], []
        if keys:
            yield handed(*merged())

    return run


def _grams(word: str) -> set[str]:
    import unicodedata

    w = "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))
    return {w[i : i + 4] for i in range(len(w) - 3)}


#: Mean cosine of a leaf's terms with an area's leaves from which it is of their kind, and from which two leaves share
#: their votes.
ALIKE, KIN = 0.35, 0.3
#: Votes from which a leaf is plainly labelled if they are half of its votes, and below which its terms have a say.
PLAIN, FEW = 2, 4
#: Weight of all like spellings together (under one vote), and the part of the leaves with a spelling that must agree.
SPELT, AGREED = 0.85, 0.6
#: What an area that no leaf of a language has yet gains, what one vote loses when leaves of other terms have the area,
#: and the least score that labels a leaf.
OPEN, STRANGE, LEAST_VOTE = 0.15, 1.0, 0.1
#: Part of what a leaf's terms say in a language that has to stand in leaves of its label.
HOME = 0.45


def label_leaves(leaf_lang: np.ndarray, size: np.ndarray, votes: np.ndarray, terms: list[dict[str, float]]) -> np.ndarray:
    """The area of each leaf, -1 for none.

    votes[leaf, area] counts hand labels; terms[leaf] weighs its discriminative words. Leaves of one language with
    like terms share their votes; a word spelt like a word of labelled leaves of another language is a weak vote.
    Where votes are few, an area that leaves of quite other terms have taken in that language counts less, and one
    that none has taken a little more; so leaves about nothing in particular mostly stay without a label.
    """
    k, n = votes.shape
    vocabulary = {w: i for i, w in enumerate(sorted({w for t in terms for w in t}))}
    m = np.zeros((k, len(vocabulary) + 1))
    for i, t in enumerate(terms):
        for w, x in t.items():
            m[i, vocabulary[w]] = x
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    like = m @ m.T * (leaf_lang[:, None] == leaf_lang[None, :])
    np.fill_diagonal(like, 1.0)
    near = np.where(like > KIN, like, 0.0)
    shared = near @ votes
    grams = [{g for w in t for g in _grams(w)} for t in terms]

    def labelled(score: np.ndarray, known: np.ndarray) -> np.ndarray:
        """known: the area of leaves whose spellings speak to other languages, -1 for none."""
        spelt = np.zeros((k, n))
        for g in sorted(set(leaf_lang.tolist())):
            table: dict[str, np.ndarray] = {}
            for i in np.flatnonzero((known >= 0) & (leaf_lang != g)):
                for s in grams[i]:
                    table.setdefault(s, np.zeros(n))[known[i]] += 1.0
            for i in np.flatnonzero(leaf_lang == g):
                for s in sorted(grams[i]):
                    if (v := table.get(s)) is not None and v.max() >= AGREED * v.sum():
                        spelt[i] += v / v.sum()
        score = score + SPELT * spelt / np.maximum(spelt.sum(1, keepdims=True), 4.0)
        out = np.full(k, -1)
        # plain votes first, then the larger leaves
        for i in np.lexsort((-score.max(1), -size, -np.minimum(np.floor(shared.max(1)), 3))):
            if not terms[i] and not strong[i]:
                continue
            s = score[i].copy()
            if shared[i].sum() < FEW:
                for a in range(n):
                    taken = (out == a) & (leaf_lang == leaf_lang[i])
                    kin = like[i, taken].mean() if taken.any() else None
                    s[a] += OPEN if kin is None else -STRANGE if kin < ALIKE else kin / 2
            out[i] = s.argmax() if s.max() > LEAST_VOTE else -1
        return out

    strong = (shared.max(1) >= PLAIN) & (shared.max(1) >= 0.5 * shared.sum(1))
    once = labelled(shared, np.where(strong, shared.argmax(1), -1))
    return labelled(shared, once)


def at_home(labels: np.ndarray, leaf_lang: np.ndarray, terms: list[dict[int, float]], counts: np.ndarray) -> np.ndarray:
    """The labels without those of leaves whose terms mostly stand in leaves that do not have the label.

    counts[leaf, term]. Words of texts about nothing in particular stand everywhere; those of a subject stand with it.
    """
    out = labels.copy()
    while True:
        home = np.ones(len(out))
        for g in np.unique(leaf_lang):
            mine = leaf_lang == g
            whole = counts[mine].sum(0)
            for a in np.unique(out[mine & (out >= 0)]):
                inside = counts[mine & (out == a)].sum(0)
                for i in np.flatnonzero(mine & (out == a)):
                    t, x = np.array(list(terms[i]), np.int64), np.array(list(terms[i].values()))
                    if len(t):
                        home[i] = (x * inside[t] / np.maximum(whole[t], 1)).sum() / x.sum()
        lost = (home < HOME) & (out >= 0)
        if not lost.any():
            return out
        out[lost] = -1


def leaf_weights(labels: np.ndarray, leaf_lang: np.ndarray, counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """weights[leaf, term]: how much more often (nats) a leaf has a term than its language outside of the leaf's label.

    The rate outside is mixed with EVEN of the leaf's own, as in a text of which the label had that part: so a weight
    is at most -log(EVEN), however much of a language a label has. A leaf without a label is measured against all
    other leaves of its language. A term weighs nothing where the leaf, or its label's leaves together, have it less
    than LEAST_LIFT oftener than outside, or in one sentence only.
    """
    out = np.zeros(counts.shape, np.float32)
    for g in np.unique(leaf_lang):
        mine = np.flatnonzero(leaf_lang == g)
        whole, all_words = counts[mine].sum(0), totals[mine].sum()
        few = 0.1 * max(int((whole > 0).sum()), 1)

        def lift(own: np.ndarray, own_words: float, inside: np.ndarray, inside_words: float) -> np.ndarray:
            own = (own + 0.1) / (own_words + few)
            other = (whole - inside + 0.1) / (all_words - inside_words + few)
            return np.log(own / (EVEN * own + (1 - EVEN) * other))

        for a in np.unique(labels[mine]):
            group = mine[labels[mine] == a]
            inside, inside_words = counts[group].sum(0), totals[group].sum()
            told = lift(inside, inside_words, inside, inside_words) > LEAST_LIFT
            for i in group:
                x = lift(counts[i], totals[i], inside, inside_words) if a >= 0 else lift(counts[i], totals[i], counts[i], totals[i])
                out[i] = np.where((x > LEAST_LIFT) & (counts[i] > 1) & (told | (a < 0)), x, 0.0)
    return out


class Weights:
    """Weights of terms in leaves without the zeros: most terms speak for a few leaves only."""

    def __init__(self, table: np.ndarray):
        """table[term, leaf]"""
        term, self.leaf = np.nonzero(table)
        self.x = table[term, self.leaf]
        self.n = table.shape[1]
        self.ends = np.searchsorted(term, np.arange(len(table) + 1))

    def scores(self, group: np.ndarray, terms: np.ndarray, groups: int) -> np.ndarray:
        """scores[group, leaf]: sums of the weights of each group's terms."""
        first, many = self.ends[terms], self.ends[terms + 1] - self.ends[terms]
        at = np.arange(many.sum()) + np.repeat(first - np.cumsum(many) + many, many)
        return np.bincount(np.repeat(group, many) * self.n + self.leaf[at], self.x[at], groups * self.n).reshape(groups, self.n)


@dataclass
class Model:
    """What sentences go to leaves by: for each language its leaves' areas (len(areas) for none) and weights."""

    areas: list[str]
    words: Words
    #: place among the words in use -> row of the weights, -1 for words that are no leaf's term
    row: np.ndarray
    leaves: dict[int, tuple[np.ndarray, Weights]]


def _share_rows(shared):
    """id, subject, hits, sentences from each document's mixture of leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        n = len(m.areas) + 1
        for b in slices(batches, "terms"):
            doc, raw, sizes, per_doc = _flat(b)
            place = m.words.place[raw]
            on = place >= 0
            sentence = np.repeat(np.arange(len(sizes)), sizes)
            langs = m.words.languages(b.column("lang").to_pylist(), doc[on], place[on])
            row = np.where(on, m.row[place], -1)
            on = row >= 0
            row, sentence, doc = row[on], sentence[on], doc[on]
            of = np.repeat(np.arange(len(per_doc)), per_doc)
            area = np.full(len(sizes), n - 1)
            for g, (areas, weights) in m.leaves.items():
                mine = langs[doc] == g
                if not mine.any():
                    continue
                speaks = np.flatnonzero(np.diff(sentence[mine], prepend=-1))
                group = np.zeros(int(mine.sum()), np.int64)
                group[speaks] = 1
                score = weights.scores(np.cumsum(group) - 1, row[mine], len(speaks))
                best = score.argmax(1)
                area[sentence[mine][speaks]] = np.where(score[np.arange(len(best)), best] > LEAST_SCORE, areas[best], n - 1)
            mixture = np.bincount(of * n + area, minlength=len(per_doc) * n).reshape(len(per_doc), n)
            d, a = np.nonzero(mixture[:, :-1])
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(d)), pa.array([m.areas[i] for i in a], pa.string()), pa.array(mixture[d, a].astype(np.int64)), pa.array(per_doc[d].astype(np.int64))], names=["id", "subject", "hits", "sentences"])

    return run


def _marked(marked: np.ndarray):
    """The rows of counts whose term is marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(marked[b.column("term").to_numpy()]))

    return run


def _top_terms(counts: DataFrame, leaves: DataFrame) -> DataFrame:
    """leaf, term, w: the TERMS most discriminative words of each leaf among those that tell in its language."""
    c = counts.join(F.broadcast(leaves), "leaf")
    whole = c.groupBy("lang", "term").agg(F.sum("n").alias("all"))
    ratio = F.log(((F.col("n") + 0.5) / F.col("in_leaf")) / ((F.col("all") + 0.5) / F.col("in_lang")))
    scored = c.where("n > 1").join(whole, ["lang", "term"]).withColumn("w", ratio * F.sqrt("n")).where("w > 0")
    return scored.withColumn("r", F.row_number().over(W.partitionBy("leaf").orderBy(F.desc("w"), "term"))).where(F.col("r") <= TERMS).select("leaf", "lang", "term", "w")


def _spellings(tokens: DataFrame, buckets: dict[int, int]) -> dict[int, str]:
    """The word of each asked bucket that most tasks have met; ties go to the shorter, then the smaller word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(buckets[i], w) for w in b.column("word").to_pylist() if (i := _bucket(w)) in buckets]
            yield pa.RecordBatch.from_pydict({"term": pa.array([r[0] for r in rows], pa.int32()), "word": pa.array([r[1] for r in rows], pa.string())})

    met = tokens.select(F.explode("fresh").alias("word")).mapInArrow(run, "term int, word string").groupBy("term", "word").agg(F.count("*").alias("n"))
    best = met.groupBy("term").agg(F.min(F.struct((-F.col("n")).alias("n"), F.length("word").alias("l"), "word")).alias("x"))
    return dict(best.select("term", "x.word").toPandas().itertuples(index=False))


def subject_shares(docs: DataFrame, labels: DataFrame, areas: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", leaves: int = LEAVES, sample: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """id, subject, hits, sentences: how many sentences of each document deal with each area (areas with none left out).

    * Areas are the trimmed lower-case subjects of `areas` (a fixed short list); labels of other areas or unknown
      documents are ignored, repeated ones count once. Without labels there are no rows.
    * Null, empty and sentence-less texts and rows without an id give no rows; repeated document rows give repeated
      results. Extra columns are ignored. Words are hashed to BUCKETS, so memory does not grow with the vocabulary.
    * The leaves are fitted on all documents. `sample` (once: documents to fit them on) is taken for the sake of older
      callers and has no effect.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    clean = lambda c: F.lower(F.trim(c))
    names = sorted(r[0] for r in areas.select(clean("subject")).where("subject is not null").distinct().limit(1_001).collect())
    if len(names) > 1_000:
        raise ValueError("more than 1000 subject areas")
    empty = spark.createDataFrame([], "id bigint, subject string, hits bigint, sentences bigint")
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    everything = scratch.save(rows.mapInArrow(_tokenise, "id bigint, lang int, terms binary, sizes binary, fresh array<string>").where("octet_length(sizes) > 0 or size(fresh) > 0"))
    tokens = everything.where("octet_length(sizes) > 0").select("id", "lang", "terms", "sizes")
    in_use = (F.col("term") < 0) | (F.col("n") >= LEAST_TEXTS)
    found = tokens.mapInArrow(_vocabulary, "lang int, term int, n bigint").groupBy("lang", "term").agg(F.sum("n").alias("n")).where(in_use).toPandas()
    n_docs = np.zeros(L)
    whole = found[found["term"] < 0]
    n_docs[whole["lang"]] = whole["n"]
    found = found[found["term"] >= 0]
    if not len(found) or not names:
        return empty
    used = np.sort(found["term"].unique())
    df = np.zeros((L, len(used)))
    df[found["lang"], np.searchsorted(used, found["term"])] = found["n"]
    w = Words(used, df, n_docs, (df >= LEAST_TEXTS) & (df <= COMMON / len(names) * n_docs[:, None]))

    def fitted() -> tuple[DataFrame, np.ndarray]:
        made = tokens.mapInArrow(_vectors(spark.sparkContext.broadcast(w)), "id bigint, v binary, lang int, cells int, common binary")
        vectors = scratch.save(made)
        return vectors, bisecting.centres(vectors.select("id", "v"), DIM + L, leaves, scratch)

    vectors, centres = fitted()
    more = _uneven(vectors, centres, df.shape, scratch)
    scratch.drop(vectors)
    if more.any():
        w = Words(used, df, n_docs, w.telling | more)
        vectors, centres = fitted()
        scratch.drop(vectors)
    k, telling = len(centres), w.telling
    placed = scratch.save(tokens.mapInArrow(_placed(spark.sparkContext.broadcast((w, centres))), "id bigint, leaf int, term int, n bigint"))
    counts = scratch.save(placed.where("term is not null").groupBy("leaf", "term").agg(F.sum("n").alias("n")))
    sums = counts.where("term < 0").toPandas()
    totals = np.zeros(k)
    totals[sums["leaf"][sums["term"] == -1]] = sums["n"][sums["term"] == -1]
    by = np.zeros((k, L))
    own = sums[sums["term"] < -1]
    by[own["leaf"], -2 - own["term"]] = own["n"]
    leaf_lang = by.argmax(1)
    marks = labels.select(F.col("doc_id").cast("bigint").alias("id"), clean("subject").alias("subject")).where(F.col("subject").isin(names)).distinct()
    voted = placed.where("term is null").select("id", "leaf").join(marks, "id").groupBy("leaf", "subject").agg(F.count("*").alias("n")).toPandas()
    votes = np.zeros((k, len(names)))
    for leaf, s, n in voted.itertuples(index=False):
        votes[leaf, names.index(s)] += n
    if not votes.sum():
        return empty

    in_lang = np.bincount(leaf_lang, totals, L)
    about = spark.createDataFrame([(i, int(g), float(totals[i]), float(in_lang[g])) for i, g in enumerate(leaf_lang)], "leaf int, lang int, in_leaf double, in_lang double")
    pairs = counts.where("term >= 0")
    best = _top_terms(pairs.mapInArrow(_telling_of(telling, leaf_lang), "leaf int, term int, n bigint"), about).toPandas().sort_values(["leaf", "w", "term"], ascending=[True, False, True])
    compared = best.groupby("leaf").head(COMPARED)
    name = _spellings(everything, {int(used[t]): int(t) for t in compared["term"].unique()})
    terms: list[dict[int, float]] = [{} for _ in range(k)]
    for leaf, _, term, x in compared.itertuples(index=False):
        terms[leaf][term] = float(x)
    spelt = [{name[t]: x for t, x in own.items() if t in name} for own in terms]

    # the counts of every term of some leaf, in all leaves
    wanted = np.sort(best["term"].unique())
    mark = np.zeros(w.size, bool)
    mark[wanted] = True
    c = pairs.mapInArrow(_marked(mark), "leaf int, term int, n bigint").toPandas()
    column = np.full(w.size, -1, np.int64)
    column[wanted] = np.arange(len(wanted))
    table = np.zeros((k, len(wanted)))
    table[c["leaf"], column[c["term"]]] = c["n"]
    label = label_leaves(leaf_lang, by.sum(1), votes, spelt)
    label = at_home(label, leaf_lang, [{int(column[t]): x for t, x in own.items()} for own in terms], table)
    weights = leaf_weights(label, leaf_lang, table, totals)
    of = np.where(label < 0, len(names), label)
    model = Model(names, w, column, {int(g): (of[leaf_lang == g], Weights(weights[leaf_lang == g].T)) for g in np.unique(leaf_lang)})
    return tokens.mapInArrow(_share_rows(spark.sparkContext.broadcast(model)), "id bigint, subject string, hits bigint, sentences bigint")


def _telling_of(telling: np.ndarray, leaf_lang: np.ndarray):
    """The rows of counts whose term tells in the language of the leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(telling[leaf_lang[b.column("leaf").to_numpy()], b.column("term").to_numpy()]))

    return run


def subjects(docs: DataFrame, labels: DataFrame, areas: DataFrame, *, share: float = SHARE, **options) -> DataFrame:
    """id, subject: the areas that at least `share` of a document's sentences deal with. See subject_shares."""
    s = subject_shares(docs, labels, areas, **options)
    return s.where(F.col("hits") + 1e-9 >= F.col("sentences") * share).select("id", "subject")
