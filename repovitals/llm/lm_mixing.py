"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is its lower-cased words and one end. Four experts know a word's
probability: after the two words before it, after the one before it, in the text
so far, and in all training texts; each is a ratio of counts. A word that no
training text holds is spelled, bit by bit. Which expert speaks is a chain of
binary decisions, asked in that order: "this one, or a later one?" The chance of
a word is the sum over the experts of what they say times the chance that the
chain stops at them, so all words' chances sum to one at most. A context of words
that was seen n times opens its gate to n / (n + 1) at most: what was seen once, in
a scored training text perhaps in that text alone, is never certain.

Each of these bits, the gates, is predicted by four predictors with contexts of
their own: how often the expert's context was seen and how well the word before
was known; the hashed word before; how well the last three words were known; and,
adapting within the text, how often the gate was open there so far. Their logits
are added with weights that a selector chooses (the gate, and how often its
context was seen), and a last table refines the probability by gate and logit.
Weights, the adaptive predictor and the refinement move while a text is scored,
every STEP words (later chunks of long texts are a GROWTH-th of what came before),
each text on its own from the same start, so no score depends on other texts
being scored or on how rows are dealt. A bit's target is the chance, after the
word is known, that its expert was the one.

Spelling: the eight bits of each byte and of a space, predicted by hashed
contexts of one, two and three bytes, mixed by how much the contexts have seen;
these tables stay as learned.

Counts are exact, 64 bits, of all words and of all runs of two and three in the
training texts; they grow with the corpus. Texts go in units of about UNIT bytes;
a unit sends its distinct runs, hashed and sorted, with their counts, to the
ranges of hashes, where all units' counts meet; each range answers every unit
with totals, so that a run crosses the network once in each direction and nothing
of the tables is sent to all. Runs are 44-bit hashes, words 64-bit ones.

The start (tables of the gates, weights, refinement, spelling) is learned on all
training texts, dealt by a hash of their rows to groups, each group in units of its
own, where every text is scored against the counts of the unit's other texts.
Sums of what the units learned are integers, so they don't depend on the order
of adding. They have a fixed size: a few thousand contexts.

Nulls: a null text is empty (its end alone); a null doc_id is the empty text for
folds. Repeated rows are scored alike. With no training text all words are
spelled. An empty table gives no rows. Other columns are dropped."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import exchanges_go, fold, lean, mix64, ranges

FOLDS, UNIT, LEARN_UNIT = 7, 4_000_000, 1_500_000
RUN_BITS = 44  # of a run's hash
#: Tokens that are mixed together, but for a longer text; more would only take more memory.
TOGETHER = 150_000
#: Tokens whose numbers a processor keeps at hand.
BLOCK = 4096
STEP, GROWTH = 32, 16
GATES, INPUTS = 4, 4
LEVELS = np.array([1, 2, 3, 5, 9, 33])  # how often a context was seen, in seven classes
CELLS = len(LEVELS) + 1
SLOTS, SPELL_BITS = 4096, 16
BUCKETS, TOP = 25, 8.0
RATE, PRIOR, KEEP = 0.05, 4.0, 16.0
NEAR = 50.0  # how firmly learned weights are held to those before, in bits
GROUP_ROWS = 2048
#: Input bytes for each range of hashes, at most, by Spark's own estimate of the table.
RANGE_BYTES = 16 << 20
END = b""
_EMPTY_HASH = np.uint64(xxhash.xxh3_64_intdigest(b""))
_END_HASH = np.uint64(xxhash.xxh3_64_intdigest(b" "))
_SCALE = float(1 << 20)


# Sorting.


def _in_order(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of so many bits in order, and where they were; equal ones as they came.

    Key and place are sorted as one number, which is several times faster than an argsort; where both don't fit into 64
    bits, keys of the same first bits are sorted apart."""
    low = len(keys).bit_length()
    kept = min(bits, 64 - low)
    if bits - kept > 4:
        at = np.argsort(keys, kind="stable")
        return keys[at], at
    down, mask = np.uint64(low), np.uint64((1 << low) - 1)
    keys = keys.astype(np.uint64, copy=False)
    if kept == bits:
        both = np.sort(keys << down | np.arange(len(keys), dtype=np.uint64))
        return both >> down, (both & mask).astype(np.int64)
    first, parts, places = (keys >> np.uint64(kept)).astype(np.int64), [], []
    for k in range(1 << bits - kept):
        at = np.flatnonzero(first == k).astype(np.uint64)
        both = np.sort((keys[at] & np.uint64((1 << kept) - 1)) << down | at)
        parts.append(both >> down | np.uint64(k << kept))
        places.append((both & mask).astype(np.int64))
    return np.concatenate(parts), np.concatenate(places)


def _distinct(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, which of them each key is, their counts)."""
    ordered, places = _in_order(keys, bits)
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    starts = np.flatnonzero(new)
    at = np.empty(len(keys), np.int64)
    at[places] = np.cumsum(new) - 1
    return ordered[starts], at, np.diff(starts, append=len(keys))


# Words and runs of words.


@dataclass
class Tokens:
    """The words of some texts: word `ids[i]` of `names` is token i; every text ends with END."""

    lens: np.ndarray  # tokens of each text
    ids: np.ndarray
    names: list[bytes]

    @classmethod
    def of(cls, texts: list[str | None]) -> Tokens:
        split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array([t or "" for t in texts], pa.large_string())))  # as words() does
        ends, every = np.asarray(split.offsets)[1:] - split.offsets[0].as_py(), split.flatten()
        empty = np.asarray(pc.equal(every, ""))  # beside white space at the ends of a text
        found = every.cast(pa.large_binary()).dictionary_encode()  # in the order of first occurrence
        ids, names = np.asarray(found.indices, np.int32), found.dictionary.to_pylist()
        if END in names:
            end = names.index(END)
        else:
            end, names = len(names), [*names, END]
        ends = ends - np.cumsum(np.append(0, empty))[ends]
        return cls(np.diff(ends, prepend=0) + 1, np.insert(ids[~empty], ends, end).astype(np.int32), names)

    def hashes(self) -> np.ndarray:
        found = np.fromiter(map(xxhash.xxh3_64_intdigest, self.names), np.uint64, len(self.names))
        found[found == _EMPTY_HASH] = _END_HASH
        return found


@dataclass
class Runs:
    """Distinct words and runs of a unit, sorted, and for each token the places of its word, pair and triple there."""

    word_keys: np.ndarray
    word_counts: np.ndarray
    keys: np.ndarray
    counts: np.ndarray
    word_at: np.ndarray
    pair_at: np.ndarray
    triple_at: np.ndarray  # of a text's first token: its pair's
    before: np.ndarray  # hash of the word before
    first: np.ndarray  # whether a token is the first of its text

    @classmethod
    def of(cls, tokens: Tokens) -> Runs:
        hashes = tokens.hashes()
        order = np.argsort(hashes)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        h = hashes[tokens.ids]
        starts = np.cumsum(tokens.lens) - tokens.lens
        first = np.zeros(len(h), bool)
        first[starts] = True
        one = np.concatenate([h[:1], h[:-1]])
        one[first] = _END_HASH
        two = np.concatenate([one[:1], one[:-1]])
        pair = mix64(h * np.uint64(0x9E3779B97F4A7C15) + mix64(one + np.uint64(2)))
        triple = mix64(pair + mix64(two + np.uint64(0x165667B19E3779F9)) + np.uint64(3))
        later = np.flatnonzero(~first)
        keys, at, counts = _distinct(np.concatenate([pair, triple[later]]) >> np.uint64(64 - RUN_BITS), RUN_BITS)
        pair_at = at[: len(h)]
        triple_at = pair_at.copy()
        triple_at[later] = at[len(h) :]
        return cls(hashes[order], np.bincount(rank[tokens.ids], minlength=len(order)), keys, counts, rank[tokens.ids], pair_at, triple_at, one, first)


# Gates.


@dataclass
class Facts:
    """What the experts know about each token: the counts of its word in their contexts, and of the contexts."""

    lens: np.ndarray
    seen: np.ndarray  # (GATES, tokens): how often the context was seen
    share: np.ndarray  # (GATES, tokens): the word's part of that
    trust: np.ndarray  # (GATES, tokens): how far a gate may open, 0 where there is no context
    spelled: np.ndarray  # log of the spelling's chance, -inf for words that are known
    before: np.ndarray  # hash of the word before
    triple: np.ndarray  # count of the token's triple

    @classmethod
    def parts(cls, tokens: Tokens, runs: Runs, word: np.ndarray, pair: np.ndarray, triple: np.ndarray, ends: int, total: int, spelled: np.ndarray) -> Iterator[Facts]:
        """Facts of some texts at a time, in order; spelled: of each name."""
        ends_at = np.cumsum(tokens.lens)
        lo = 0
        while lo < len(tokens.lens):
            before = int(ends_at[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends_at, before + TOGETHER, "right")))
            at = slice(before, int(ends_at[hi - 1]))
            some = Tokens(tokens.lens[lo:hi], tokens.ids[at], tokens.names)
            yield cls.of(some, runs.first[at], runs.before[at], word[at], pair[at], triple[at], ends, total, spelled[tokens.ids[at]])
            lo = hi

    @classmethod
    def of(cls, tokens: Tokens, first: np.ndarray, before: np.ndarray, word: np.ndarray, pair: np.ndarray, triple: np.ndarray, ends: int, total, spelled: np.ndarray) -> Facts:
        """word, pair, triple: counts for each token; ends, total: of all training texts (total may differ by token)."""
        n = len(word)
        seen, part = np.zeros((GATES, n), np.int64), np.zeros((GATES, n), np.int64)
        place = np.arange(n) - np.repeat(np.cumsum(tokens.lens) - tokens.lens, tokens.lens)
        seen[0, 1:], part[0] = pair[:-1], triple
        seen[0][first] = 0
        seen[1, 1:], part[1] = word[:-1], pair
        seen[1][first] = ends
        seen[2], part[2] = place, _earlier(tokens)
        seen[3], part[3] = total, word
        share = np.where(seen > 0, part / np.maximum(seen, 1), 0.0)
        trust = (seen > 0).astype(np.float64)
        trust[:2] = seen[:2] / (seen[:2] + 1)
        return cls(tokens.lens, seen, share, trust, np.where(word > 0, -np.inf, spelled), before, np.where(first, 0, triple))

    def contexts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(cell, i1, i2, i3): the class of how often each gate's context was seen, and the contexts of three predictors."""
        place = np.arange(len(self.before)) - np.repeat(np.cumsum(self.lens) - self.lens, self.lens)
        known = np.minimum(self.triple, 3)
        back = lambda k: np.where(place >= k, np.concatenate([np.zeros(k, np.int64), known[:-k]])[: len(known)], 0)
        gate = np.arange(GATES)[:, None]
        cell = np.searchsorted(LEVELS, self.seen.ravel(), "right").reshape(self.seen.shape)
        i1 = (gate * CELLS + cell) * 4 + back(1)
        i2 = gate * SLOTS + (mix64(self.before) >> np.uint64(52)).astype(np.int64)
        i3 = gate * 64 + back(1) * 16 + back(2) * 4 + back(3)
        return cell, i1, i2, i3


def _earlier(tokens: Tokens) -> np.ndarray:
    """How often each token's word came before in its text."""
    doc = np.repeat(np.arange(len(tokens.lens)), tokens.lens)
    pair = doc * np.int64(len(tokens.names)) + tokens.ids
    sorted_, order = _in_order(pair, (len(tokens.lens) * len(tokens.names)).bit_length())
    start = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    out = np.empty(len(pair), np.int64)
    out[order] = np.arange(len(pair)) - np.repeat(start, np.diff(np.append(start, len(pair))))
    return out


def chunk_starts(most: int) -> np.ndarray:
    """Where chunks of a text of `most` words begin."""
    out = [0]
    while out[-1] < most:
        out.append(out[-1] + max(STEP, out[-1] // GROWTH))
    return np.array(out[:-1] or [0])


def _logit(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


@dataclass
class Start:
    """What every text's scoring starts from."""

    tables: list[np.ndarray]  # logits of three predictors' contexts
    weights: np.ndarray  # (GATES, CELLS, INPUTS)
    refine: np.ndarray  # (GATES, BUCKETS): chance of an open gate by logit
    spelling: np.ndarray  # (3, slots, 2): zeros and ones counted

    SIZES = (GATES * CELLS * 4, GATES * SLOTS, GATES * 64)

    @classmethod
    def plain(cls) -> Start:
        edges = np.linspace(-TOP, TOP, BUCKETS)
        sigmoid = 1 / (1 + np.exp(-edges))
        return cls([np.zeros(n) for n in cls.SIZES], np.full((GATES, CELLS, INPUTS), 0.3), np.tile(sigmoid, (GATES, 1)), np.zeros((3, 1 << SPELL_BITS, 2)))


def logits_of(counts: np.ndarray, base: np.ndarray | None = None) -> np.ndarray:
    """Logits of contexts from (closed, open) counts, drawn towards base where little was seen."""
    p = 0.5 if base is None else 1 / (1 + np.exp(-base))
    return _logit(np.clip((counts[:, 1] + p) / (counts.sum(1) + 1), 1e-4, 1 - 1e-4))


def posterior(facts: Facts, gates: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log of each token's chance, r, reached): r[k] that expert k was the one, reached[k] that the chain came to it, times its trust."""
    log_p, r, reached = np.empty(gates.shape[1]), np.empty(gates.shape), np.empty(gates.shape)
    for lo in range(0, gates.shape[1], BLOCK):
        at = slice(lo, lo + BLOCK)
        log_p[at], r[:, at], reached[:, at] = _posterior(facts.trust[:, at], facts.share[:, at], facts.spelled[at], gates[:, at])
    return log_p, r, reached


def _posterior(trust: np.ndarray, share: np.ndarray, spelled: np.ndarray, gates: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    open_ = gates * trust
    said = open_ * share
    left = 1 - open_[0]
    for k in range(1, GATES):
        said[k] *= left
        left *= 1 - open_[k]
    by_count = said.sum(0)
    known = by_count > 0
    rest = left * np.exp(spelled)
    p = np.where(known, by_count + rest, 1.0)
    log_p = np.log(p)
    if len(new := np.flatnonzero(~known)):  # in logs, as a long spelling's chance may be too small for a number
        with np.errstate(divide="ignore"):
            log_p[new] = np.log(left[new]) + spelled[new]
    r = said
    r /= p
    reached = np.empty_like(r)
    after = np.where(known, rest / p, 1.0)
    for k in range(GATES - 1, -1, -1):
        after = after + r[k]
        np.minimum(after, 1.0, out=reached[k])
    reached *= trust
    return log_p, r, reached


def run_mixer(facts: Facts, start: Start) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(natural log of each text's chance, weights that each text ends with, refinement counts of each gate)."""
    n_docs = len(facts.lens)
    cell, i1, i2, i3 = facts.contexts()
    doc = np.repeat(np.arange(n_docs), facts.lens)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(facts.lens) - facts.lens, facts.lens)
    starts = chunk_starts(int(facts.lens.max(initial=0)))
    chunk = np.searchsorted(starts, place, "right") - 1
    order = _in_order(chunk, len(starts).bit_length())[1]
    cuts = np.searchsorted(chunk[order], np.arange(len(starts) + 1))
    x = [t[i[:, order]] for t, i in zip(start.tables, (i1, i2, i3), strict=True)]
    lean, doc_at = PRIOR / (1 + np.exp(-x[0])), doc[order]
    cell = cell[:, order] + np.arange(GATES)[:, None] * CELLS
    trust, share, spelled = facts.trust[:, order], facts.share[:, order], facts.spelled[order]
    # By input, or closed and open; of each text and its contexts.
    weights = np.tile(start.weights.reshape(1, GATES * CELLS, INPUTS).transpose(2, 0, 1), (1, n_docs, 1))
    told, fine = np.zeros((2, n_docs, GATES * CELLS)), np.zeros((2, n_docs, GATES * BUCKETS))
    gate, prior = np.arange(GATES)[:, None] * BUCKETS, KEEP * start.refine.ravel()
    log_p = np.empty(len(doc))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a == b:
            continue
        mine = doc_at[a:b]
        new = np.concatenate([[True], mine[1:] != mine[:-1]])
        active, row = mine[new], np.cumsum(new) - 1
        w, t, f = (y[:, active].reshape(len(y), -1) for y in (weights, told, fine))
        k = row * (GATES * CELLS) + cell[:, a:b]
        own = lean[:, a:b]
        inputs = [x[0][:, a:b], x[1][:, a:b], x[2][:, a:b], np.log((t[1][k] + own) / (t[0][k] + (PRIOR - own)))]
        z = w[0][k] * inputs[0]
        for i in range(1, INPUTS):
            z += w[i][k] * inputs[i]
        np.clip(z, -TOP + 1e-6, TOP - 1e-6, out=z)
        spot = (z + TOP) * ((BUCKETS - 1) / (2 * TOP))
        low = spot.astype(np.int64)
        part = spot - low
        b_in = gate + low
        b_at = row * (GATES * BUCKETS) + b_in
        fit = (np.tile(prior, len(active)) + f[1]) / (KEEP + f[0] + f[1])
        left = fit[b_at]
        squashed = 1 / (1 + np.exp(-z))
        gates = (squashed + left + (fit[b_at + 1] - left) * part) / 2
        log_p[a:b], r, reached = _posterior(trust[:, a:b], share[:, a:b], spelled[a:b], gates)
        flat, near = k.ravel(), (b_at + (part >= 0.5)).ravel()
        error = r - reached * squashed
        scale = RATE / np.sqrt(np.maximum(np.bincount(flat, minlength=w.shape[1]), 1))
        for i in range(INPUTS):
            w[i] += np.bincount(flat, (error * inputs[i]).ravel(), w.shape[1]) * scale
        opened, closed = r.ravel(), np.maximum(reached - r, 0).ravel()
        for index, table in ((flat, t), (near, f)):
            table[1] += np.bincount(index, opened, table.shape[1])
            table[0] += np.bincount(index, closed, table.shape[1])
        for y, now in ((weights, w), (told, t), (fine, f)):
            y[:, active] = now.reshape(len(y), len(active), -1)
    sums = np.bincount(doc_at, log_p, n_docs)
    return sums, weights.transpose(1, 2, 0).reshape(n_docs, GATES, CELLS, INPUTS), fine.sum(1).reshape(2, GATES, BUCKETS).transpose(1, 2, 0)


def fitted(facts: Facts, contexts: tuple[np.ndarray, ...], start: Start, may: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights, refinement counts of each gate) for all texts at once, from those of start.

    Weights move by one Newton step, in each gate and class of its own. As a text begins, its adaptive input is the first
    predictor's, so both share that one's weight. may: which gates may open; the others' bits are certain and teach nothing."""
    cell, *indices = contexts
    size = GATES * CELLS
    few = start.weights.reshape(size, INPUTS)[:, :3] + start.weights.reshape(size, INPUTS)[:, 3:] * [1, 0, 0]
    slope, bend, refine = np.zeros((size, 3)), np.zeros((size, 3, 3)), np.zeros((2, GATES * BUCKETS))

    def blocks(w: np.ndarray) -> Iterator[tuple]:
        for lo in range(0, cell.shape[1], BLOCK):
            at = slice(lo, lo + BLOCK)
            which = np.flatnonzero(may[:, at])
            gate = which // may[:, at].shape[1]
            k = gate * CELLS + cell[:, at].ravel()[which]
            x = [t[i[:, at].ravel()[which]] for t, i in zip(start.tables, indices, strict=True)]
            z = w[0][k] * x[0]
            for i in (1, 2):
                z += w[i][k] * x[i]
            np.clip(z, -TOP + 1e-6, TOP - 1e-6, out=z)
            p = 1 / (1 + np.exp(-z))
            gates = np.zeros(may[:, at].shape)
            gates.ravel()[which] = p
            _, r, reached = _posterior(facts.trust[:, at], facts.share[:, at], facts.spelled[at], gates)
            yield k, gate, x, z, p, r.ravel()[which], reached.ravel()[which]

    for k, _, x, _, p, r, reached in blocks(np.ascontiguousarray(few.T)):
        error, firm = r - reached * p, reached * p * (1 - p)
        for i in range(3):
            slope[:, i] += np.bincount(k, error * x[i], size)
            each = firm * x[i]
            for j in range(i + 1):
                bend[:, i, j] += np.bincount(k, each * x[j], size)
    bend += np.tril(bend, -1).transpose(0, 2, 1) + NEAR * np.eye(3)
    few = np.clip(few + np.linalg.solve(bend, slope[..., None])[..., 0], -0.5, 2.0)
    for _, gate, _, z, _, r, reached in blocks(np.ascontiguousarray(few.T)):
        near = gate * BUCKETS + np.rint((z + TOP) * ((BUCKETS - 1) / (2 * TOP))).astype(np.int64)
        refine[0] += np.bincount(near, np.maximum(reached - r, 0), GATES * BUCKETS)
        refine[1] += np.bincount(near, r, GATES * BUCKETS)
    weights = np.stack([few[:, 0] / 2, few[:, 1], few[:, 2], few[:, 0] / 2], 1)
    return weights.reshape(GATES, CELLS, INPUTS), refine.reshape(2, GATES, BUCKETS).transpose(1, 2, 0)


# Spelling.


@dataclass
class Letters:
    """Bytes of words and of the space after each, each distinct one with the three before it taken once."""

    word: np.ndarray  # of each byte
    at: np.ndarray  # its place in grams
    grams: np.ndarray  # a byte, and the three before it in the word in the higher bits
    counts: np.ndarray  # of grams
    n: int  # words

    @classmethod
    def of(cls, names: list[bytes]) -> Letters:
        sizes = np.fromiter(map(len, names), np.int64, len(names)) + 1
        data = np.frombuffer(b" ".join(names) + b" ", np.uint8).astype(np.uint32)
        place = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        grams = data.copy()
        for k in (1, 2, 3):
            grams[k:] |= np.where(place[k:] >= k, data[:-k], np.uint32(0)) << np.uint32(8 * k)
        grams, at, counts = _distinct(grams, 32)
        grams = grams.astype(np.uint32)
        return cls(np.repeat(np.arange(len(names)), sizes), at, grams, counts, len(names))

    def bits(self) -> tuple[np.ndarray, np.ndarray]:
        """(bit, slots (3, bits)) of the eight bits of each gram's byte."""
        b1, b2, b3 = ((self.grams >> np.uint32(8 * k)) & np.uint32(255) for k in (1, 2, 3))
        contexts = [b1 + np.uint32(1 << 24), b1 | b2 << np.uint32(8) | np.uint32(2 << 24), b1 | b2 << np.uint32(8) | b3 << np.uint32(16)]
        depth = np.tile(np.arange(8, dtype=np.uint32), len(self.grams))
        byte = np.repeat(self.grams & np.uint32(255), 8)
        node = (np.uint32(1) << depth) | (byte >> (np.uint32(8) - depth))
        slots = []
        for context in contexts:
            x = np.repeat(context * np.uint32(0x9E3779B1), 8) ^ node * np.uint32(0x85EBCA6B)
            x = (x ^ (x >> np.uint32(15))) * np.uint32(0xC2B2AE35)
            slots.append((x ^ (x >> np.uint32(13))) >> np.uint32(32 - SPELL_BITS))
        return ((byte >> (np.uint32(7) - depth)) & 1).astype(np.int64), np.stack(slots).astype(np.int64)

    def counted(self, bit: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Zeros and ones that each context's bits were: (3, slots, 2)."""
        many = np.repeat(self.counts, 8)
        return np.stack([np.bincount(s * 2 + bit, many, 2 << SPELL_BITS).reshape(-1, 2) for s in slots])

    def spelled(self, bit: np.ndarray, slots: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Natural log of each word's chance."""
        top, low = np.zeros(len(bit)), np.full(len(bit), 0.02)
        for j, trust in enumerate((0.5, 1.0, 2.0)):
            shut, open_ = tables[j, :, 0], tables[j, :, 1]
            w = trust * np.sqrt(shut + open_)  # a context weighs by what it has seen
            top += (w * np.log((open_ + 0.4) / (shut + 0.4)))[slots[j]]
            low += w[slots[j]]
        z = np.clip(top / low, -TOP, TOP)
        each = -np.logaddexp(0, np.where(bit == 1, -z, z)).reshape(-1, 8).sum(1)
        return np.bincount(self.word, each[self.at], self.n)


def spelled_bits(names: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, bit, slots (3, bits)) of every bit of words and of the space after each, in order."""
    letters = Letters.of(names)
    bit, slots = letters.bits()
    every = (letters.at[:, None] * 8 + np.arange(8)).ravel()
    return np.repeat(letters.word, 8), bit[every], slots[:, every]


def spell(names: list[bytes], tables: np.ndarray) -> np.ndarray:
    """Natural log of the chance of each word's spelling."""
    out = np.zeros(len(names))
    for lo in range(0, len(names), 100_000):
        some = Letters.of(names[lo : lo + 100_000])
        out[lo : lo + some.n] = some.spelled(*some.bits(), tables)
    return out


# The start, learned on all training texts.


def learn_unit(tokens: Tokens) -> np.ndarray:
    """What one unit adds to the start, as one array of sums: each text against the counts of the others."""
    runs = Runs.of(tokens)
    doc = np.repeat(np.arange(len(tokens.lens)), tokens.lens)

    def others(docs: np.ndarray, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        _, index, own = _distinct(docs * np.int64(len(counts)) + at, (len(tokens.lens) * len(counts)).bit_length())
        return counts[at] - own[index]

    word = others(doc, runs.word_at, runs.word_counts)
    later = np.flatnonzero(~runs.first)
    left = others(np.concatenate([doc, doc[later]]), np.concatenate([runs.pair_at, runs.triple_at[later]]), runs.counts)
    pair, triple = left[: len(doc)], np.zeros(len(doc), np.int64)
    triple[later] = left[len(doc) :]
    letters = Letters.of(tokens.names)
    bit, slots = letters.bits()
    spelling = letters.counted(bit, slots)
    spelled = letters.spelled(bit, slots, spelling * 0.8)[tokens.ids]
    facts = Facts.of(tokens, runs.first, runs.before, word, pair, triple, len(tokens.lens) - 1, len(doc) - np.repeat(tokens.lens, tokens.lens), spelled)
    cell, i1, i2, i3 = contexts = facts.contexts()
    may = facts.trust > 0
    which = np.flatnonzero(may)
    i1, i2, i3 = (i.ravel()[which] for i in (i1, i2, i3))
    gates = np.zeros(facts.seen.shape)

    def taught(p: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
        """(closed, open) of the gates that may open, when they do so by p."""
        gates.ravel()[which] = p
        _, r, reached = posterior(facts, gates)
        r = r.ravel()[which]
        return np.maximum(reached.ravel()[which] - r, 0), r

    def counted(i: np.ndarray, n: int, bits: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return np.stack([np.bincount(i, v, n) for v in bits], 1)

    first = logits_of(counted(i1, Start.SIZES[0], taught(0.5)))
    bits = taught((1 / (1 + np.exp(-first)))[i1])
    tables = [counted(i, n, bits) for i, n in zip((i1, i2, i3), Start.SIZES, strict=True)]
    start = Start.plain()
    start.tables = [logits_of(t) for t in tables]
    weights, refine = fitted(facts, contexts, start, may)
    many = np.bincount((np.arange(GATES)[:, None] * CELLS + cell).ravel(), minlength=GATES * CELLS).reshape(GATES, CELLS)
    parts = [*(t.ravel() for t in tables), (weights * many[..., None]).ravel(), many.ravel(), refine.ravel(), spelling.ravel()]
    return np.rint(np.concatenate(parts) * _SCALE).astype(np.int64)


def start_of(sums: np.ndarray) -> Start:
    """The start from the units' sums."""
    start, at = Start.plain(), 0

    def take(*shape: int) -> np.ndarray:
        nonlocal at
        size = int(np.prod(shape))
        at += size
        return (sums[at - size : at] / _SCALE).reshape(shape)

    start.tables = [logits_of(take(n, 2)) for n in Start.SIZES]
    weights, many = take(GATES, CELLS, INPUTS), take(GATES, CELLS)
    start.weights = np.where(many[..., None] > 0, weights / np.maximum(many, 1)[..., None], start.weights)
    refine = take(GATES, BUCKETS, 2)
    start.refine = (refine[..., 1] + KEEP * start.refine) / (refine.sum(-1) + KEEP)
    start.spelling = take(3, 1 << SPELL_BITS, 2)
    return start


SUMS = sum(Start.SIZES) * 2 + GATES * CELLS * (INPUTS + 1) + GATES * BUCKETS * 2 + 6 * (1 << SPELL_BITS)


def learned(docs: DataFrame, held_fold: int, _tune_fold: int | None = None) -> Start:
    """The start from all training texts. _tune_fold, once the only fold learned from, is without effect."""
    some = _prepared(docs).where(F.col("fold") != held_fold).select("doc_id", "text")
    groups = max(1, -(-some.count() // GROUP_ROWS))
    dealt = some.withColumn("grp", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size, now = None, [], 0, None

        def rows():
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            yield None, None

        for group, text in rows():
            if held and (group != now or size >= LEARN_UNIT):
                found = learn_unit(Tokens.of(held))
                total = found if total is None else total + found
                held, size = [], 0
            now = group
            held.append(text)
            size += len(text or "") + 100
        if total is not None:
            used = np.flatnonzero(total)
            yield pa.record_batch([pa.array(used), pa.array(total[used])], ["at", "value"])

    ordered = dealt.repartition("grp").sortWithinPartitions("grp", "doc_id", "text").select("grp", "text")
    found = ordered.mapInArrow(lean(learn), "at long, value long").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    sums = np.zeros(SUMS, np.int64)
    sums[np.asarray(found.column("at"))] = np.asarray(found.column("value"))
    return start_of(sums) if found.num_rows else Start.plain()


# The exchange of counts.


def _prepared(docs: DataFrame) -> DataFrame:
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    return docs.select(doc_id, F.col("text").cast("string").alias("text"), fold(F.col("doc_id"), FOLDS).cast("int").alias("fold"))


def press(x: np.ndarray) -> bytes:
    """Numbers by zstd, bytes of the same weight together."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpress(x: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def press_keys(keys: np.ndarray) -> bytes:
    """Sorted keys, as steps from one to the next."""
    return press(np.diff(keys, prepend=np.uint64(0)))


def unpress_keys(x: bytes) -> np.ndarray:
    return np.cumsum(unpress(x, np.uint64), dtype=np.uint64)


def press_counts(counts: np.ndarray) -> bytes:
    """Counts, mostly small: one byte each, and those that need more once again in full."""
    small = zstandard.ZstdCompressor(level=1).compress(np.minimum(counts, 255).astype(np.uint8).tobytes())
    return len(small).to_bytes(4, "little") + small + press(counts[counts >= 255].astype(np.int64))


def unpress_counts(x: bytes) -> np.ndarray:
    n = int.from_bytes(x[:4], "little")
    out = np.frombuffer(zstandard.ZstdDecompressor().decompress(x[4 : 4 + n]), np.uint8).astype(np.int64)
    out[out == 255] = unpress(x[4 + n :], np.int64)
    return out


#: Keys that are added up at once.
SUMMED = 1_000_000


class _Sums:
    """Counts of keys that come in parts, added up over all parts."""

    def __init__(self):
        self.keys, self.counts = [], []

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts.astype(np.min_scalar_type(int(counts.max(initial=0)))))

    def _parts(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(places, starts of equal keys in them, those keys, their sums) of all keys, some ranges of keys at a time, in order."""
        keys = np.concatenate(self.keys or [np.zeros(0, np.uint64)])
        counts = np.concatenate(self.counts or [np.zeros(0, np.uint8)])
        if not len(keys):
            return
        least = keys.min()
        bits = int(keys.max() - least).bit_length()
        apart = min(bits, (len(keys) // SUMMED).bit_length())
        mine = (keys - least) >> np.uint64(bits - apart) if apart else None
        for k in range(1 << apart):
            at = np.flatnonzero(mine == np.uint64(k)) if apart else np.arange(len(keys))
            if len(at):
                some = keys[at]
                low = some.min()
                ordered, places = _in_order(some - low, int(some.max() - low).bit_length())
                starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
                at = at[places]
                yield at, starts, ordered[starts] + low, np.add.reduceat(counts[at], starts, dtype=np.int64)

    def done(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct keys and their sums."""
        found = [(keys, sums) for _, _, keys, sums in self._parts()]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def told(self) -> tuple[list[np.ndarray], int, int]:
        """(the sums of each part's keys, the sum of all, how many keys have one)."""
        out, total, distinct = np.empty(sum(map(len, self.keys)), np.int64), 0, 0
        for at, starts, _, sums in self._parts():
            out[at] = np.repeat(sums, np.diff(starts, append=len(at)))
            total, distinct = total + int(sums.sum()), distinct + int(np.count_nonzero(sums))
        return np.split(out, np.cumsum([len(x) for x in self.keys])[:-1]) if self.keys else [], total, distinct


def _totals(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    known, counts = table
    if not len(known):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, counts[at], 0)


#: Kinds of rows: a unit's texts; its words; its runs. A negative unit tells a range's sums.
TEXTS, WORDS, RUNS = 0, 1, 2
_SENT = "home int, unit long, kind int, nth int, a binary, b binary"


def _row(home: int, unit: int, kind: int, nth: int, a: bytes, b: bytes = b"") -> pa.RecordBatch:
    columns = [pa.array([home], pa.int32()), pa.array([unit], pa.int64()), pa.array([kind], pa.int32()), pa.array([nth], pa.int32())]
    return pa.record_batch([*columns, pa.array([a], pa.binary()), pa.array([b], pa.binary())], ["home", "unit", "kind", "nth", "a", "b"])


def _cuts(keys: np.ndarray, n: int, bits: int) -> list[int]:
    """Cuts of sorted keys at the borders of n ranges of the same width."""
    return [0, *np.searchsorted(keys, np.array([-(-(k << bits) // n) for k in range(1, n)], np.uint64)).tolist(), len(keys)]


def _units(batches: Iterator[pa.RecordBatch], held_fold: int) -> Iterator[tuple[bool, list]]:
    """(held out, rows (doc_id, text)) of about UNIT bytes of text."""
    held, sizes = {False: [], True: []}, {False: 0, True: 0}
    for batch in batches:
        for doc_id, text, f in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            out = f == held_fold
            held[out].append((doc_id, text))
            sizes[out] += len(text or "") + 100
            if sizes[out] >= UNIT:
                yield out, held[out]
                held[out], sizes[out] = [], 0
    yield from ((out, rows) for out, rows in held.items() if rows)


def scores(docs: DataFrame, held_fold: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    n = ranges(docs, RANGE_BYTES)
    kept = spark.sparkContext.broadcast(learned(docs, held_fold))
    exchanges_go(spark)  # those of learning

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for nth, (out, rows) in enumerate(_units(batches, held_fold)):
            tokens = Tokens.of([t for _, t in rows])
            runs = Runs.of(tokens)
            n_bytes = np.array([len((t or "").encode()) for _, t in rows], np.int64)
            names = zstandard.ZstdCompressor(level=1).compress(b"\n".join(tokens.names))
            data = pickle.dumps((out, [d for d, _ in rows], n_bytes, tokens.lens, names, press(tokens.ids)))
            unit = xxhash.xxh3_64_intdigest(data, part * 1_000_003 + nth) >> 1
            yield _row(unit % n, unit, TEXTS, 0, data)
            for kind, keys, counts, bits in ((WORDS, runs.word_keys, runs.word_counts, 64), (RUNS, runs.keys, runs.counts, RUN_BITS)):
                cuts = _cuts(keys, n, bits)
                for k in range(n):
                    if cuts[k] < cuts[k + 1]:
                        some = slice(cuts[k], cuts[k + 1])
                        yield _row(k, unit, kind, k, press_keys(keys[some]), b"" if out else press_counts(counts[some]))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts pass; all counts of this range are added up, then every unit is told its totals, and every home the range's sums."""
        sums, asked = {WORDS: _Sums(), RUNS: _Sums()}, {WORDS: [], RUNS: []}
        for batch in batches:
            for row in batch.to_pylist():
                if (kind := row["kind"]) == TEXTS:
                    yield _row(row["home"], row["unit"], TEXTS, 0, row["a"])
                else:
                    keys = unpress_keys(row["a"])
                    sums[kind].add(keys, unpress_counts(row["b"]) if row["b"] else np.zeros(len(keys), np.uint8))
                    asked[kind].append((row["unit"], row["nth"]))
        for kind, units in asked.items():
            found, total, distinct = sums.pop(kind).told()
            if kind == WORDS:
                told, nth = np.array([total, distinct], np.int64).tobytes(), next((k for x in asked.values() for _, k in x), None)
                for home in range(n) if nth is not None else ():
                    yield _row(home, -1 - nth, TEXTS, 0, told)
            for (unit, nth), x in zip(units, found, strict=True):
                yield _row(unit % n, unit, kind, nth, press_counts(x))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, total, distinct = kept.value, 0, 0
        now, data, answers = None, None, {}

        def done() -> Iterator[pa.RecordBatch]:
            if data is not None:
                yield _scored(pickle.loads(data), answers, start, total, distinct)

        for batch in batches:
            for unit, kind, a in zip(*(batch.column(c).to_pylist() for c in ("unit", "kind", "a")), strict=True):
                if unit < 0:
                    total, distinct = (total, distinct) + np.zeros(2, np.int64) + np.frombuffer(a, np.int64)
                    continue
                if unit != now:
                    yield from done()
                    now, data, answers = unit, None, {WORDS: [], RUNS: []}
                if kind == TEXTS:
                    data = a
                else:
                    answers[kind].append(unpress_counts(a))
        yield from done()

    sent = _prepared(docs).mapInArrow(lean(send), _SENT).repartitionById(n, F.col("home"))
    met = sent.mapInArrow(lean(answer), _SENT).repartitionById(n, F.col("home")).sortWithinPartitions("unit", "kind", "nth")
    return met.mapInArrow(lean(score), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")


def _scored(unit: tuple, answers: dict[int, list[np.ndarray]], start: Start, total: int, distinct: int) -> pa.RecordBatch:
    """The rows of one unit. total, distinct: training tokens and different ones."""
    out, doc_ids, n_bytes, lens, names, ids = unit
    tokens = Tokens(lens, unpress(ids, np.int32), zstandard.ZstdDecompressor().decompress(names).split(b"\n"))
    runs = Runs.of(tokens)
    word_counts, run_counts = (np.concatenate(answers[k]) if answers[k] else np.zeros(0, np.int64) for k in (WORDS, RUNS))
    if len(word_counts) != len(runs.word_keys) or len(run_counts) != len(runs.keys):
        raise ValueError("a unit's answers are not those to its questions: its rows changed while it was asked")
    word, pair = word_counts[runs.word_at], run_counts[runs.pair_at]
    triple = np.where(runs.first, 0, run_counts[runs.triple_at])
    ends = int(_totals((runs.word_keys, word_counts), np.array([_END_HASH]))[0])
    by_name = np.zeros(len(tokens.names), np.int64)
    by_name[tokens.ids] = word
    spelled = np.zeros(len(tokens.names))
    if len(new := np.flatnonzero(by_name == 0)):
        spelled[new] = spell([tokens.names[i] for i in new.tolist()], start.spelling)
    logs = np.concatenate([run_mixer(facts, start)[0] for facts in Facts.parts(tokens, runs, word, pair, triple, ends, total, spelled)])
    doc = np.repeat(np.arange(len(lens)), lens)
    base = np.bincount(doc, np.log10(word + 1.0), len(lens)) - lens * np.log10(float(total + distinct + 1))
    known = np.bincount(doc, word > 0, len(lens)).astype(np.int64)
    with np.errstate(divide="ignore", invalid="ignore"):
        per_byte = np.where(n_bytes > 0, -logs / np.log(2) / n_bytes, np.nan)
    columns = [pa.array(doc_ids, pa.int64()), pa.array([out] * len(lens)), pa.array(lens), pa.array(known), pa.array(np.full(len(lens), total, np.int64))]
    names_ = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
    return pa.record_batch([*columns, pa.array(base), pa.array(logs / np.log(10)), pa.array(per_byte, from_pandas=True)], names_)
