"""SentencePiece encoding and decoding: Gumbel top-k segmentations without replacement (operator 10).

The public model file gives the pieces. A unigram model's scores are its pieces' log-probabilities. The production file is
a merge model, whose scores are the negated ranks of its merges and no probabilities, so there a piece's log-probability is
taken from its rank by a Zipf-Mandelbrot law (nothing is trained). No piece crosses the end of a unit (blanks and the run of
known characters after them, or one unknown character, which is spelt in byte pieces), so the lattice of a text is the
product of its units' lattices, and the perturbed A-star search works on units: a node of its agenda is "as in sample r
before unit i, and there none of the segmentations E", bounded by a Gumbel variable of that subtree's whole mass that is
truncated at its parent's. The best node always holds the next sample.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, fresh, lean, mix64, powers, q

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES, SEED = 2, 23
CHUNK = 1 << 18
_BYTES = 1 << 16  # a token from here on is the code point of an unknown character
_MASK = (1 << 20) - 1
#: Units whose lattices a worker keeps from its first batches on. It changes no result.
KEPT_UNITS = 30_000
_STRAIGHT = 40  # characters over which probabilities multiply without vanishing; logarithms beyond


class Vocabulary:
    """Pieces with their ids and log-probabilities, found by the hash of their code points."""

    def __init__(self, pieces: dict[str, int], byte_id: int, log_prob: dict[int, float], byte_log_prob: float):
        self.pieces, self.byte_id, self.byte_log_prob = pieces, byte_id, byte_log_prob
        code = np.arange(0x110000)
        self.log_prob = np.full(_BYTES + len(code), -np.inf)  # by token
        self.log_prob[list(log_prob)] = list(log_prob.values())
        self.log_prob[_BYTES:] = byte_log_prob * (1 + (code > 0x7F).astype(int) + (code > 0x7FF) + (code > 0xFFFF))
        self.log_prob[byte_id : byte_id + 128] = byte_log_prob
        self.chance = np.exp(self.log_prob)
        self.kept, self.kept_net, self.pending, self.waiting = np.zeros(0, np.uint64), None, [], 0  # see Nets
        self.single = np.zeros(0x110000, bool)
        self.single[[ord(p) for p in pieces if len(p) == 1]] = True
        self.kind = np.full(0x110000, 2, np.uint8)  # 0 the blank, 1 characters of pieces, 2 others
        self.kind[[ord(c) for p in pieces for c in p]] = 1
        self.kind[32] = 0
        spelt = {i: p.encode() for p, i in pieces.items()} | {byte_id + b: bytes([b]) for b in range(256)}
        self.bytes = [spelt.get(i, b"") for i in range(max(spelt) + 1)]
        self.byte_size = np.array([len(b) for b in self.bytes], np.int64)
        self.byte_begin = np.cumsum(self.byte_size) - self.byte_size
        self.byte_flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        # every beginning of a piece is found, so that a search can end as soon as no piece begins so
        heads = list(dict.fromkeys(p[:k] for p in pieces for k in range(1, len(p) + 1)))
        code = np.frombuffer("".join(heads).encode("utf-32-le"), np.uint32).astype(np.uint64)
        size = np.array([len(p) for p in heads])
        end = np.cumsum(size)
        total, down = self._sums(code), powers(len(code) + 1)[1]
        with np.errstate(over="ignore"):
            h = mix64((total[end] - total[end - size]) * down[end - size] + size.astype(np.uint64))
        self.hash, self.id = h, np.array([pieces.get(p, -1) for p in heads], np.int32)
        self.tables, left, shift = [], np.arange(len(h)), 0
        while len(left):
            slot = np.full(_MASK + 1, -1, np.int32)
            at = (h[left] >> np.uint64(shift)).astype(np.int64) & _MASK
            slot[at] = left
            left, shift = left[slot[at] != left], shift + 20
            self.tables.append(slot)

    def _sums(self, code: np.ndarray) -> np.ndarray:
        up = powers(len(code) + 1)[0]
        with np.errstate(over="ignore"):
            return np.concatenate((np.zeros(1, np.uint64), np.cumsum((code + np.uint64(1)) * up[: len(code)], dtype=np.uint64)))

    def hashes(self, code: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Of stretches of code points."""
        total, down = self._sums(code.astype(np.uint64)), powers(len(code) + 1)[1]
        with np.errstate(over="ignore"):
            return mix64((total[start + size] - total[start]) * down[start] + size.astype(np.uint64))

    def units(self, code: np.ndarray, text_start: np.ndarray) -> np.ndarray:
        """Where units begin: with a text, with blanks, with an unknown character and after it."""
        kind = self.kind[code]
        cut = kind == 2
        cut[1:] |= kind[:-1] == 2
        cut[1:] |= (kind[1:] == 0) & (kind[:-1] != 0)
        cut[text_start] = True
        return np.flatnonzero(cut)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash among the beginnings of pieces, -1 for none."""
        out = np.full(len(h), -1, np.int32)
        for i, slot in enumerate(self.tables):
            at = slot[(h >> np.uint64(20 * i)).astype(np.int64) & _MASK]
            hit = (at >= 0) & (self.hash[at] == h)
            out[hit] = at[hit]
        return out

    def decode(self, ids) -> str:
        """The text of ids; the blank that encoding puts before it is dropped."""
        if len(ids) and min(ids) < 0:
            raise IndexError("an id below 0")
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


@functools.cache
def load(path: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    scores = np.array([model.get_score(i) for i in ids])
    # the scores of a merge model count down by one; those of a unigram model are logarithms of shares
    merges = len(scores) > 1 and bool((scores == np.round(scores)).all())
    law = np.array([-math.log(r + 2.7) for r in range(1, len(ids) + 1)])
    log_prob = dict(zip(ids, (law - np.log(np.exp(law).sum()) if merges else scores).tolist(), strict=True))
    return Vocabulary({model.id_to_piece(i).replace("▁", " "): i for i in ids}, model.piece_to_id("<0x00>"), log_prob, min(log_prob.values()) - 1.0)


class Lattices:
    """The lattices of some distinct units, the longest first: the places after t characters lie together, so that one
    step over all units reads and writes whole slices."""

    def __init__(self, v: Vocabulary, code: np.ndarray, size: np.ndarray):
        """For units of so many code points each, one after the other in ``code``."""
        self.v = v
        order = np.argsort(-size, kind="stable")
        code = gather(code, (np.cumsum(size) - size)[order], size[order])
        total, down = v._sums(code.astype(np.uint64)), powers(len(code) + 1)[1]
        self.size, size = size, size[order]
        longest = int(size[0]) if len(size) else 0
        base = np.cumsum(size) - size
        many = np.searchsorted(-size, -np.arange(longest + 1), "right")  # units of t characters or more
        self.off = np.cumsum(many) - many
        self.rank = np.empty(len(size), np.int64)
        self.rank[order] = np.arange(len(size))
        nodes = int(many.sum())
        unit = np.repeat(np.arange(len(size)), size)
        after = np.arange(len(code)) - base[unit]  # characters before each
        at, last = np.arange(len(code)), size[unit] - after
        hits, k = [], 0
        while len(at):
            k += 1
            with np.errstate(over="ignore"):
                piece = v.find(mix64((total[at + k] - total[at]) * down[at] + np.uint64(k)))
            at, piece = at[piece >= 0], piece[piece >= 0]
            token = v.id[piece]
            whole = token >= 0
            if whole.any():
                hits.append((k, self.off[after[at[whole]] + k] + unit[at[whole]], token[whole]))
            at = at[last[at] > k]
        odd = np.flatnonzero(~v.single[code])
        hits.append((1, self.off[after[odd] + 1] + unit[odd], np.where(code[odd] < 128, v.byte_id + code[odd], _BYTES + code[odd]).astype(np.int32)))
        self.wide = wide = -(-max(k for k, _, _ in hits) // 8) * 8
        arc = np.full((wide, nodes), -1, np.int32)
        chance = np.zeros((wide, nodes))
        for k, node, token in hits:
            arc[k - 1, node] = token
            chance[k - 1, node] = v.chance[token]
        # every place has an arc of one character, so one segmentation means no other arc
        other = np.zeros(len(size), bool)
        for k, node, _ in hits:
            if k > 1:
                other[node - self.off[np.searchsorted(self.off, node, "right") - 1]] = True
        self.single = ~other[self.rank]
        straight = np.ones(nodes)
        deep = {int(t) for k, node, _ in hits if k > 8 for t in np.unique(np.searchsorted(self.off, node, "right") - 1)}
        for t in range(1, min(longest, _STRAIGHT) + 1):
            a, m = int(self.off[t]), int(many[t])
            e = chance[: wide if t in deep else 8, a : a + m]
            for k in range(1, len(e) + 1):
                if k <= t:
                    e[k - 1] *= straight[int(self.off[t - k]) : int(self.off[t - k]) + m]
                if k > 1:
                    e[k - 1] += e[k - 2]
            straight[a : a + m] = e[-1]
            e /= straight[a : a + m]
        self.alpha = np.log(straight)
        for t in range(_STRAIGHT + 1, longest + 1):  # products would vanish
            a, m = int(self.off[t]), int(many[t])
            with np.errstate(divide="ignore"):
                x = np.log(chance[:, a : a + m])
            for k in range(1, min(wide, t) + 1):
                x[k - 1] += self.alpha[int(self.off[t - k]) : int(self.off[t - k]) + m]
            top = x.max(0)
            e = np.exp(x - top).cumsum(0)
            self.alpha[a : a + m] = top + np.log(e[-1])
            chance[:, a : a + m] = e / e[-1]
        # the sums of the first eight arcs, to 24 bits, are what nearly every step needs of a place, in half a line of cache;
        # places with longer arcs have the rest of theirs apart
        self.upto, self.token = np.ascontiguousarray(chance[:8].T, np.float32), np.ascontiguousarray(arc[:8].T)
        self.far = np.flatnonzero((arc[8:] >= 0).any(0))
        self.far_upto, self.far_token = np.ascontiguousarray(chance[8:, self.far].T), np.ascontiguousarray(arc[8:, self.far].T)
        self.known: dict[tuple[int, int], list] = {}

    def sample(self, unit: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, count, log_prob): one segmentation of each unit, drawn by its probability with the random numbers
        that follow from ``key``; the tokens of the i-th begin after those before it."""
        t, rank = self.size[unit], self.rank[unit]
        whole, count, steps, step = self.alpha[self.off[t] + rank], np.zeros(len(t), np.int64), [], 0
        live = np.arange(len(t))
        while len(live):
            at = self.off[t] + rank
            u = uniform(key, step)
            above = u.astype(np.float32)[:, None] >= self.upto[at]
            k = np.bitwise_count(above.view(np.uint64)[:, 0]).astype(np.int64)  # eight flags a word
            token = self.token[at, np.minimum(k, 7)]
            odd = np.flatnonzero((k == 8) | (token < 0))
            for i in odd.tolist():  # an arc of more than eight characters, or a sum that is 1 but for rounding
                token[i], k[i] = self.long_arc(int(at[i]), float(u[i]))
            steps.append((live, token))
            count[live] += 1
            t = t - k - 1
            more = t > 0
            live, t, rank, key, step = live[more], t[more], rank[more], key[more], step + 1
        last = np.cumsum(count)
        tokens = np.empty(int(count.sum()), np.int32)
        for s, (who, token) in enumerate(steps):
            tokens[last[who] - 1 - s] = token
        total = np.add.reduceat(self.v.log_prob[tokens], last - count) if len(t) or len(count) else np.zeros(0)
        return tokens, count, total - whole

    def arcs_at(self, node: int) -> list[tuple[int, int]]:
        """(length - 1, token) of the arcs that end at a place."""
        tokens = self.token[node].tolist()
        at = int(np.searchsorted(self.far, node))
        if at < len(self.far) and self.far[at] == node:
            tokens += self.far_token[at].tolist()
        return [(k, token) for k, token in enumerate(tokens) if token >= 0]

    def long_arc(self, node: int, u: float) -> tuple[int, int]:
        """(token, length - 1) of the arc that a number beyond the first eight sums takes: the last one if there is none."""
        found = self.arcs_at(node)
        at = int(np.searchsorted(self.far, node))
        if at < len(self.far) and self.far[at] == node:
            k = 8 + int((u >= self.far_upto[at]).sum())
            longer = [(x, token) for x, token in found if x >= k and x >= 8]
            if longer:
                return longer[0][1], longer[0][0]
        return found[-1][1], found[-1][0]

    def arcs(self, rank: int, t: int) -> list[tuple[int, int, float]]:
        """(token, characters before it, its share) of the arcs that end after t characters of a unit."""
        found = self.known.get((rank, t))
        if found is None:
            if len(self.known) > 20_000:
                self.known.clear()
            node = int(self.off[t]) + rank
            found = self.known[rank, t] = [(token, t - k - 1, math.exp(self.v.log_prob[token] + self.alpha[int(self.off[t - k - 1]) + rank] - self.alpha[node])) for k, token in self.arcs_at(node)]
        return found

    def suffixes(self, rank: int, t: int, without: list[tuple[int, ...]]) -> tuple[list[dict[int, int]], list[float]]:
        """The tree of the endings of ``without``, of each node which token leads to which node, and what share of the paths
        that end so are others: summed up from the leaves, without subtraction and without recursion."""
        nodes, kids = [(t, list(range(len(without))), 0)], []
        for place, group, depth in nodes:  # grows as it goes
            following: dict[int, list[int]] = {}
            if place:
                for w in group:
                    following.setdefault(without[w][-1 - depth], []).append(w)
            mine = {}
            if following:
                for token, before, _ in self.arcs(rank, place):
                    if token in following:
                        mine[token] = len(nodes)
                        nodes.append((before, following[token], depth + 1))
            kids.append(mine)
        share = [0.0] * len(nodes)
        for i in range(len(nodes) - 1, -1, -1):
            place, mine = nodes[i][0], kids[i]
            if place:
                share[i] = sum(p * (share[mine[token]] if token in mine else 1.0) for token, _, p in self.arcs(rank, place))
        return kids, share

    def mass(self, unit: int, without: list[tuple[int, ...]]) -> float:
        """Share of a unit's segmentations other than ``without``."""
        return self.suffixes(int(self.rank[unit]), int(self.size[unit]), without)[1][0]

    def sample_without(self, unit: int, key: int, without: list[tuple[int, ...]]) -> tuple[tuple[int, ...], float]:
        """A segmentation other than ``without``, by its share of what is left, and its log-probability."""
        rank, t, tokens, log_prob, step = int(self.rank[unit]), int(self.size[unit]), [], 0.0, 0
        kids, left = self.suffixes(rank, t, without)
        at: int | None = 0  # None: no longer an ending of one that is left out
        while t:
            arcs = self.arcs(rank, t)
            mine = kids[at] if at is not None else {}
            share = [p * (left[mine[token]] if token in mine else 1.0) for token, _, p in arcs]
            u = uniform_of(key, step) * sum(share)
            i = 0
            while i < len(share) - 1 and (u >= share[i] or share[i] == 0.0):
                u -= share[i]
                i += 1
            while share[i] == 0.0:
                i -= 1
            token, t, p = arcs[i]
            at = mine.get(token)
            tokens.append(token)
            log_prob += math.log(p)
            step += 1
        return tuple(tokens[::-1]), log_prob


class Nets:
    """The lattices of a batch's distinct units; those of units that this worker's first batches had are kept."""

    def __init__(self, v: Vocabulary, code: np.ndarray, start: np.ndarray, size: np.ndarray, name: np.ndarray):
        """For units by their places in ``code`` and their hashes ``name``."""
        at = np.searchsorted(v.kept, name)
        self.is_new = np.ones(len(name), bool)
        if len(v.kept):
            self.is_new = v.kept[np.minimum(at, len(v.kept) - 1)] != name
        new = np.flatnonzero(self.is_new)
        mine = gather(code, start[new], size[new])
        self.old_net, self.net, self.at = v.kept_net, Lattices(v, mine, size[new]), at
        self.at[new] = np.arange(len(new))
        self.single = np.ones(len(name), bool)
        self.single[new] = self.net.single
        if self.old_net is not None:
            self.single[~self.is_new] = self.old_net.single[at[~self.is_new]]
        elif len(new):
            v.pending.append((name, mine, size[new]))
            v.waiting += len(new)
            if v.waiting >= KEPT_UNITS:
                names, codes, sizes = (np.concatenate(x) for x in zip(*v.pending, strict=True))
                v.kept, first = np.unique(names, return_index=True)
                v.kept_net = Lattices(v, gather(codes, (np.cumsum(sizes) - sizes)[first], sizes[first]), sizes[first])
                v.pending = []

    def of(self, unit: int) -> tuple[Lattices, int]:
        return (self.net if self.is_new[unit] else self.old_net), int(self.at[unit])

    def sample(self, unit: np.ndarray, key: np.ndarray, store) -> np.ndarray:
        """Segmentations of the units, each handed to ``store``; what it returns for them."""
        out = np.empty(len(unit), np.int64)
        new = self.is_new[unit]
        for net, mine in ((self.net, np.flatnonzero(new)), (self.old_net, np.flatnonzero(~new))):
            if len(mine):
                out[mine] = store(*net.sample(self.at[unit[mine]], key[mine]))
        return out


_M1, _M2 = 0xD1342543DE82EF95, 0xAF251AF3B0F025B5


def uniform(key: np.ndarray, step: int) -> np.ndarray:
    """In (0, 1), by key and step; keys are well mixed already."""
    with np.errstate(over="ignore"):
        x = key + np.uint64((step + 1) * 0xD1B54A32D192ED03 & (2**64 - 1))
        x *= np.uint64(_M1)
        x ^= x >> np.uint64(32)
        x *= np.uint64(_M2)
        x >>= np.uint64(12)
    out = x.astype(np.float64)
    out += 0.5
    out *= 2.0**-52
    return out


def uniform_of(key: int, step: int) -> float:
    """``uniform`` of one key."""
    full = 2**64 - 1
    x = ((key + (step + 1) * 0xD1B54A32D192ED03) * _M1) & full
    x = ((x ^ (x >> 32)) * _M2) & full
    return ((x >> 12) + 0.5) * 2.0**-52


def keys(row: np.ndarray, sample: int, unit: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(row + mix64(unit.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019) + np.uint64(sample)))


def truncated(mass: np.ndarray, top: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variables of location ``mass`` (a logarithm) below ``top``."""
    return -np.logaddexp(-top, np.log(-np.log(u)) - mass)


def gather(flat: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """flat[first[i] : first[i] + count[i]] for all i, one after the other."""
    shift = np.repeat(first - (np.cumsum(count) - count), count)
    return flat[np.arange(int(count.sum())) + shift]


def segmentations(v: Vocabulary, texts: list[str | None], rows: np.ndarray, k: int) -> list[tuple[int, int, np.ndarray, float, float, float, bool]]:
    """(text, rank, ids, log_prob, perturbed, log_inclusion, lossless) of up to ``k`` distinct segmentations of each text."""
    code = np.frombuffer("".join([" " + t for t in texts if t]).encode("utf-32-le", "surrogatepass"), np.uint32)
    chars = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
    begins = np.cumsum(chars) - chars
    start = v.units(code, begins[chars > 0]) if len(code) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(code)))
    many = np.diff(np.searchsorted(start, np.append(begins, len(code))))
    first = np.cumsum(many) - many
    name, where, unit = np.unique(v.hashes(code, start, size), return_index=True, return_inverse=True)
    net = Nets(v, code, start[where], size[where], name)
    doc = np.repeat(np.arange(len(texts)), many)
    nth = np.arange(len(unit)) - first[doc]
    # segmentations of units that some sample holds
    flat, begin, size, logp = [], [], [], []
    stored = held = 0

    def store(tokens: np.ndarray, count: np.ndarray, lp: np.ndarray) -> np.ndarray:
        nonlocal stored, held
        flat.append(tokens)
        begin.append(held + np.cumsum(count) - count)
        size.append(count)
        logp.append(lp)
        held += len(tokens)
        stored += len(count)
        return np.arange(stored - len(count), stored)

    def piece(ref: int) -> tuple[int, ...]:
        for b, s, f, in zip(begin, size, flat, strict=True):
            if ref < len(b):
                at = int(b[ref] - b[0]) if len(b) else 0
                return tuple(f[at : at + int(s[ref])].tolist())
            ref -= len(b)
        raise IndexError(ref)

    one = net.single[unit]
    top = -np.log(-np.log(uniform(rows ^ np.uint64(0xA5A5A5A5), 0)))
    store(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0))
    refs = [net.sample(unit, keys(rows[doc], 1, nth), store)]
    best, alive = [top], [np.array([t is not None for t in texts], bool)]

    def rest(sample: int, after: np.ndarray) -> tuple[np.ndarray, ...]:
        """Nodes of the sample's units from ``after[text]`` on: (text, unit's place, sample, prefix mass, bound)."""
        lp = np.concatenate(logp)[refs[sample]]
        upto = np.cumsum(lp) - lp
        prefix = upto - (upto[first[doc]] if len(doc) else 0)
        with np.errstate(divide="ignore"):
            mass = prefix + np.where(one, -np.inf, np.log(-np.expm1(np.minimum(lp, 0.0))))
        take = np.flatnonzero((nth >= after[doc]) & np.isfinite(mass) & alive[sample][doc])
        d = doc[take]
        bound = truncated(mass[take], best[sample][d], uniform(keys(rows[d], 1000 + sample, nth[take]), 0))
        return d, take, np.full(len(take), sample), prefix[take], bound

    nodes = [np.asarray(x) for x in rest(0, np.zeros(len(texts), np.int64))]
    without: dict[tuple[int, int, int], list[int]] = {}
    for r in range(1, k + 1):  # the k+1-th gives the threshold only
        d, take, sample, prefix, bound = nodes
        value = np.full(len(texts), -np.inf)
        np.maximum.at(value, d, bound)
        lead = np.flatnonzero(bound == value[d])
        lead = lead[np.unique(d[lead], return_index=True)[1]]
        best.append(value)
        alive.append(np.isfinite(value))
        if r == k:
            break
        after, base = np.full(len(texts), 1 << 60), np.zeros(len(texts), np.int64)
        after[d[lead]], base[d[lead]] = nth[take[lead]], sample[lead]
        old = refs[0] if len(refs) == 1 else np.stack(refs)[base[doc], np.arange(len(doc))]
        fresh_at = np.flatnonzero(nth > after[doc])
        new = old.copy()
        new[fresh_at] = net.sample(unit[fresh_at], keys(rows[doc[fresh_at]], r + 1, nth[fresh_at]), store)
        drawn, split = [], []
        for x in lead:
            t, s = int(take[x]), int(sample[x])
            out = without.get((int(d[x]), s, t), [int(refs[s][t])])
            gone = [piece(o) for o in out]
            lattice, u = net.of(int(unit[t]))
            tokens, lp = lattice.sample_without(u, int(keys(rows[d[x] : d[x] + 1], r + 1, nth[t : t + 1])[0]), gone)
            drawn.append((t, tokens, lp))
            left = lattice.mass(u, [*gone, tokens])
            split.append((int(d[x]), t, s, float(prefix[x]), left, out))
        ids = store(np.array([i for _, tokens, _ in drawn for i in tokens], np.int32), np.array([len(tokens) for _, tokens, _ in drawn], np.int64), np.array([lp for _, _, lp in drawn]))
        new[[t for t, _, _ in drawn]] = ids
        refs.append(new)
        keep = np.ones(len(d), bool)
        keep[lead] = False
        again = [x for x in zip(split, ids, strict=True) if x[0][4] > 0]
        for (dd, t, s, _, _, out), ref in again:
            without[dd, s, t] = [*out, int(ref)]
        sd = np.array([x[0][0] for x in again], np.int64)
        st = np.array([x[0][1] for x in again], np.int64)
        ss = np.array([x[0][2] for x in again], np.int64)
        sp = np.array([x[0][3] for x in again])
        sb = truncated(sp + np.log(np.array([x[0][4] for x in again])), value[sd], uniform(keys(rows[sd], 2000 + r, nth[st]), 0)) if again else np.zeros(0)
        later = rest(r, after + 1)
        nodes = [np.concatenate((a[keep], b, c)) for a, b, c in zip(nodes, (sd, st, ss, sp, sb), later, strict=True)]
    flat, begin, size, logp = (np.concatenate(x) for x in (flat, begin, size, logp))
    out = []
    kappa = best[k]
    told = np.frombuffer("".join([" " + t for t in texts if t]).encode("utf-8", "surrogatepass"), np.uint8)
    told_size = np.array([len(t.encode("utf-8", "surrogatepass")) + 1 if t else 0 for t in texts], np.int64)
    for r in range(k):
        ref = refs[r] if r < len(refs) else refs[0]
        tokens = gather(flat, begin[ref], size[ref])
        per = np.bincount(doc, weights=size[ref], minlength=len(texts)).astype(np.int64)
        lp = np.bincount(doc, weights=logp[ref], minlength=len(texts))
        tokens, per = spell(v, tokens, per)
        ends = np.cumsum(per)
        back, size_back = gather(v.byte_flat, v.byte_begin[tokens], v.byte_size[tokens]), np.zeros(len(texts), np.int64)
        np.add.at(size_back, np.repeat(np.arange(len(texts)), per), v.byte_size[tokens])
        if np.array_equal(size_back, told_size) and np.array_equal(back, told):
            same = np.ones(len(texts), bool)
        else:
            z1, z2 = np.cumsum(size_back), np.cumsum(told_size)
            same = np.array([np.array_equal(back[z1[i] - size_back[i] : z1[i]], told[z2[i] - told_size[i] : z2[i]]) for i in range(len(texts))], bool)
        above = lp - kappa
        with np.errstate(over="ignore"):
            inclusion = np.where(above < -30, above, np.log(-np.expm1(-np.exp(np.maximum(above, -30)))))
        for i in np.flatnonzero(alive[r]):
            out.append((int(i), r + 1, tokens[ends[i] - per[i] : ends[i]], float(lp[i]), float(best[r][i]), float(inclusion[i]), bool(same[i])))
    return out


def spell(v: Vocabulary, tokens: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unknown characters as byte pieces."""
    odd = np.flatnonzero(tokens >= _BYTES)
    if not len(odd):
        return tokens, per
    coded = [np.frombuffer(chr(c - _BYTES).encode("utf-8", "surrogatepass"), np.uint8) for c in tokens[odd].tolist()]
    count = np.ones(len(tokens), np.int64)
    count[odd] = [len(c) for c in coded]
    last = np.cumsum(count)
    out = np.repeat(tokens, count)
    out[np.repeat(last[odd] - count[odd] - (np.cumsum(count[odd]) - count[odd]), count[odd]) + np.arange(int(count[odd].sum()))] = np.concatenate(coded).astype(np.int32) + v.byte_id
    edge = np.concatenate(([0], last))
    stop = np.cumsum(per)
    return out, edge[stop] - edge[stop - per]


def row_keys(ids: np.ndarray, hashes: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(ids.view(np.uint64) + mix64(hashes.view(np.uint64) + np.uint64(seed)))


def model_file(spark, path: str) -> str:
    """The vocabulary file on its way to the executors (its name there)."""
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encode(docs: DataFrame, k: int = SAMPLES, seed: int = SEED, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sample, ids, n_tokens, log_prob, perturbed, log_inclusion, lossless): up to ``k`` distinct segmentations of
    each whole text, the best perturbed first; lossless: their ids decode to the text.

    log_inclusion is the logarithm of the probability that a segmentation's perturbed log-probability exceeds the k+1-th
    one, 1 - exp(-exp(log_prob - threshold)). The random numbers follow from ``seed``, the id and the text's hash alone, so
    neither partitions nor batches nor reruns change a row.

    - NULL text: no row. Empty text: one row without ids (log_prob 0, log_inclusion 0).
    - A text with fewer than ``k`` segmentations: as many rows as there are, log_inclusion 0.
    - Very long texts and texts without blanks are one lattice like any other; unknown characters and U+2581 in the text
      become byte pieces, so decoding gives every valid text back.
    - Repeated rows get the same samples. NULL id: seeded as the least id, and NULL in the result.
    - Empty table: empty result. Extra columns: not read. Ids are integers, or strings of digits; others are an error.
    """
    name = model_file(docs.sparkSession, model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(SparkFiles.get(name))
        for batch in lean(batches):
            for part in chunks(batch, "t", CHUNK):
                texts = part.column("t").to_pylist()
                ids = part.column("d").fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
                rows = segmentations(v, texts, row_keys(ids, part.column("rh").to_numpy(zero_copy_only=False), seed), k)
                at = pa.array([r[0] for r in rows], pa.int64())
                count = np.array([len(r[2]) for r in rows], np.int64)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32)), pa.array(np.concatenate([r[2] for r in rows]).astype(np.int32) if rows else np.zeros(0, np.int32)))
                columns = [part.column("d").take(at), pa.array([r[1] for r in rows], pa.int32()), ids, pa.array(count.astype(np.int32)), *(pa.array([r[i] for r in rows], pa.float64()) for i in (3, 4, 5)), pa.array([r[6] for r in rows], pa.bool_())]
                yield pa.record_batch(columns, names=["d", "sample", "ids", "n_tokens", "log_prob", "perturbed", "log_inclusion", "lossless"])

    slim = docs.select(q(id_col).cast("long").alias("d"), F.xxhash64(q(text_col)).alias("rh"), q(text_col).alias("t"))
    return slim.mapInArrow(each, "d bigint, sample int, ids array<int>, n_tokens int, log_prob double, perturbed double, log_inclusion double, lossless boolean").withColumnRenamed("d", id_col)


def decode(encoded: DataFrame, model: str = MODEL, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """``encoded`` with the texts of its ids in ``out_col``; NULL ids give NULL, no ids the empty text; an id outside
    the vocabulary is an error."""
    name = model_file(encoded.sparkSession, model)
    key, = fresh(encoded, "ids")
    schema = encoded.select(*[q(c) for c in encoded.columns if c != out_col]).schema.add(out_col, "string")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(SparkFiles.get(name))
        for batch in lean(batches):
            texts = [None if ids is None else v.decode(ids) for ids in batch.column(key).to_pylist()]
            kept = [c for c in batch.schema.names if c != key]
            yield pa.record_batch([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], names=[*kept, out_col])

    return encoded.select(*[q(c) for c in encoded.columns if c != out_col], q(ids_col).alias(key)).mapInArrow(each, schema)
