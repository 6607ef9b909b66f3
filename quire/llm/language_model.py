"""Operator 7, document log-likelihoods by a gated recurrent language model with class-factored output.

Counts of all training tokens are gathered over the whole corpus. The most frequent words (HEAD) are inputs and outputs
of the network; every other word belongs to one of TAIL classes by its last two bytes. A token's probability is
    P(class | state) * P(word | class, state)   for head words, whose classes are runs of the frequency order,
    P(class | state) * (c + 1) / (N_k + V_k + 1)   for others, c their training count and N_k, V_k their class's sums,
so the model is normalised over all words seen and one unseen word in each tail class.

The network (GRU, numpy) is trained by truncated backpropagation on documents joined to parallel streams whose state is
reset where a document begins. It starts on the driver with `sample_docs` training documents; every other training
document is then learnt from in one of ROUNDS rounds, in which each partition trains the network of the round before
and the changes are averaged, each row of a matrix by how often its words occurred. Scoring carries the state through
each document to its end: documents of a batch advance together, longest first.

The counts of the KNOWN most frequent words go to the workers (a bounded table); the counts of rarer ones are joined
to the documents that hold them, so the vocabulary may grow without bound.

Defined cases: null and blank texts are one end token; without training documents every count is 0 and the network is
untrained; repeated rows are scored each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialize, text_of
from quire.llm.tokens import words

HEAD, HEAD_CLASS, TAIL, KNOWN, HIDDEN = 4096, 64, 64, 1 << 19, 24
#: Rounds of the distributed training; tokens a partition has at least, where the table has them; tokens trained at once.
ROUNDS, PART_TOKENS, BLOCK_TOKENS = 3, 1 << 20, 1 << 22
#: Rows whose output layer is computed at once, so that it stays in the processor's cache.
BLOCK_ROWS = 1024
#: The token that ends each document.
END = np.int64(0x5E17_E2D0_0C5E_17E2)


def token_rows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For blocks of rows: tokens (int64) with the end token after each row's words, and the rows' ends. A token is the
    hash of its word but for the last bits, which are its tail class."""
    low = np.uint64(TAIL - 1)
    for _, h, ending, bounds in words(column):
        at = bounds[1:] - bounds[0]
        yield np.insert((h & ~low | ending & low).view(np.int64), at, END), at + np.arange(1, len(at) + 1)


def tail_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens & np.int64(TAIL - 1)).astype(np.int32)


@dataclass
class Vocabulary:
    """token: sorted known tokens; log_count: log10(count + 1); unit: what the network takes a token for, a head word
    (its rank) or HEAD + tail class."""

    token: np.ndarray
    log_count: np.ndarray
    unit: np.ndarray
    total: int
    distinct: int
    head_size: int
    head_counts: np.ndarray
    tail_words: np.ndarray  # of each tail class, N_k
    tail_kinds: np.ndarray  # and V_k

    @cached_property
    def directory(self) -> tuple[np.ndarray, int, int]:
        """For each value of the first bits of a token, how many known ones are below all tokens that begin so; the shift
        that leaves these bits; the most known tokens that begin alike."""
        bits = max(1, len(self.token).bit_length())
        alike = np.bincount((self.token >> (64 - bits)) + (1 << bits - 1), minlength=1 << bits)
        return np.r_[0, np.cumsum(alike)[:-1]], 64 - bits, int(alike.max())

    def find(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each token among the known ones, and whether it is one."""
        if not len(self.token):
            return np.zeros(len(tokens), np.int64), np.zeros(len(tokens), bool)
        if len(tokens) < 1 << 12 or self.directory[2] > 64:
            at = np.searchsorted(self.token, tokens)
        else:  # hashes are spread evenly: a step or two from where the directory points
            below, shift, _ = self.directory
            at = below.take((tokens >> shift) + (len(below) >> 1))
            last = len(self.token) - 1
            rest = np.flatnonzero(self.token.take(at, mode="clip") < tokens)
            while len(rest):
                at[rest] += 1
                rest = rest[at[rest] <= last]
                rest = rest[self.token[at[rest]] < tokens[rest]]
        at[at >= len(self.token)] = 0
        return at, self.token.take(at) == tokens

    def units(self, tokens: np.ndarray, at: np.ndarray, known: np.ndarray) -> np.ndarray:
        unit = HEAD + tail_of(tokens)
        unit[known] = self.unit[at[known]]
        return unit


def distinct_by_row(row: np.ndarray, token: np.ndarray, rows: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each of `rows` rows its distinct tokens, and how often it has each; `row` says whose a token is."""
    order = np.lexsort((token, row))
    row, token = row[order], token[order]
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (token[1:] != token[:-1])]) if len(row) else np.zeros(0, np.int64)
    times, ends = np.diff(np.r_[first, len(row)]).astype(np.int32), np.searchsorted(row[first], np.arange(1, rows))
    return np.split(token[first], ends), np.split(times, ends)


def count_tokens(docs: DataFrame) -> DataFrame:
    """token and c of all tokens of docs (text, not null)."""

    def batches(it: Iterator[pa.RecordBatch], most: int = 3_000_000) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            token, c = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(token), pa.array(c.astype(np.int64))], ["token", "c"])

        for b in it:
            for token, _ in token_rows(b.column(0)):
                held.append(token)
                n += len(token)
                if n >= most:
                    yield flush()
                    held, n = [], 0
        yield flush()

    return docs.select("text").mapInArrow(batches, "token bigint, c bigint").groupBy("token").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """counts: written, as it is read three times."""
    sums = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    top = counts.orderBy(F.desc("c"), "token").limit(KNOWN).toArrow()
    token, c = (top.column(x).to_numpy() for x in ("token", "c"))
    rank = np.lexsort((token, -c))
    token, c = token[rank], c[rank]
    tail = tail_of(token)
    words_, kinds = np.zeros(TAIL), np.zeros(TAIL)
    for r in counts.groupBy(F.col("token").bitwiseAND(F.lit(TAIL - 1)).alias("tail")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():  # TAIL rows
        words_[r["tail"]], kinds[r["tail"]] = r["n"], r["v"]
    head = min(HEAD, len(token))
    words_ -= np.bincount(tail[:head], c[:head], TAIL)
    kinds -= np.bincount(tail[:head], minlength=TAIL)
    unit = HEAD + tail
    unit[:head] = np.arange(head)
    order = np.argsort(token)
    return Vocabulary(token[order], np.log10(c[order] + 1.0), unit[order], sums["n"] or 0, sums["v"], head, c[:head].astype(float), words_, kinds)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place. Where exp overflows, the result is zero, as it should be."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


@dataclass
class Network:
    """Inputs are rows of `x`; classes 0 to HEAD / HEAD_CLASS - 1 hold head words, the rest are tail classes."""

    x: np.ndarray
    u: np.ndarray
    wc: np.ndarray
    bc: np.ndarray
    wo: np.ndarray
    bo: np.ndarray
    tail_log: np.ndarray = field(default_factory=lambda: np.zeros(TAIL))

    @staticmethod
    def start(v: Vocabulary, seed: int = 3) -> Network:
        """Begins at the corpus's unigrams: biases are logarithms of counts."""
        rng = np.random.default_rng(seed)
        normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        heads = np.zeros(HEAD)
        heads[: v.head_size] = v.head_counts
        classes = np.r_[heads.reshape(-1, HEAD_CLASS).sum(1), v.tail_words] + 1.0
        return Network(
            normal(0.1, HEAD + TAIL, 3 * HIDDEN), normal(0.15, HIDDEN, 3 * HIDDEN), normal(0.02, HIDDEN, len(classes)), np.log(classes / classes.sum()).astype(np.float32),
            normal(0.02, HEAD, HIDDEN), np.where(np.arange(HEAD) < v.head_size, np.log(heads + 1.0), -40.0).astype(np.float32), -np.log(v.tail_words + v.tail_kinds + 1.0),
        )

    def parameters(self) -> list[np.ndarray]:
        return [self.x, self.u, self.wc, self.bc, self.wo, self.bo]

    def gates(self) -> tuple[np.ndarray, np.ndarray]:
        """x and u apart by gate (update, reset, new), so that each gate's values lie together."""
        return by_gate(self.x), by_gate(self.u)

    def step(self, unit: np.ndarray, h: np.ndarray, gates: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        x, u = gates or self.gates()
        a, g = x.take(unit, axis=1), np.matmul(h, u)
        zr, n = g[:2], g[2]
        zr += a[:2]
        with np.errstate(over="ignore"):
            z, r = _sigmoid(zr)
        n *= r
        n += a[2]
        np.tanh(n, out=n)
        h = h - n
        h *= z
        h += n
        return h

    def log_probability(self, h: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Natural logarithm of P(class) and, for head words, P(word | class); for tail units, of 1 / (N_k + V_k + 1)."""
        cls = class_of(unit)
        out = np.empty(len(h))
        for at in range(0, len(h), BLOCK_ROWS):
            some = slice(at, at + BLOCK_ROWS)
            logits = h[some] @ self.wc
            logits += self.bc
            out[some] = logits[np.arange(len(logits)), cls[some]]
            np.exp(logits, out=logits)  # logits stay small: unit states and clipped weights
            out[some] -= np.log(logits.sum(1))
        is_tail = unit >= HEAD
        out[is_tail] += self.tail_log[unit[is_tail] - HEAD]
        order = np.argsort(np.where(is_tail, HEAD, unit).astype(np.int16), kind="stable")
        ends = np.searchsorted(unit[order[: len(order) - is_tail.sum()]], np.arange(0, HEAD + 1, HEAD_CLASS))
        for k in range(HEAD // HEAD_CLASS):
            some = order[ends[k] : ends[k + 1]]
            if len(some):
                part = slice(k * HEAD_CLASS, (k + 1) * HEAD_CLASS)
                logits = h[some] @ self.wo[part].T
                logits += self.bo[part]
                logits -= self.bo[part].max()
                out[some] += logits[np.arange(len(some)), unit[some] - k * HEAD_CLASS]
                np.exp(logits, out=logits)
                out[some] -= np.log(logits.sum(1))
        return out


def by_gate(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.reshape(len(x), 3, HIDDEN).swapaxes(0, 1))


def class_of(unit: np.ndarray) -> np.ndarray:
    return np.where(unit < HEAD, unit // HEAD_CLASS, unit - HEAD + HEAD // HEAD_CLASS)


def output_gradients(net: Network, h: np.ndarray, y: np.ndarray, block: int = BLOCK_ROWS) -> tuple[np.ndarray, ...]:
    """Of the mean of -ln P(y | h): gradients with respect to h, wc, bc, wo and bo."""
    n, H, kind = len(y), HIDDEN, h.dtype
    cls, ones = class_of(y), np.ones(max(HEAD_CLASS, len(net.bc)), kind)
    h1 = np.ones((n, H + 1), kind)  # the last column's weights are the biases
    h1[:, :H] = h
    wc = np.vstack([net.wc, net.bc])
    large = (np.abs(net.wc).sum(0) + net.bc).max() > 80  # states are below one
    dh, dwc = np.empty_like(h), np.zeros_like(wc)

    def less_the_goals(p: np.ndarray, goals: np.ndarray) -> None:
        """From logits, the gradient with respect to them."""
        np.exp(p, out=p)
        p *= (1 / (n * (p @ ones[: p.shape[1]])))[:, None]
        p.reshape(-1)[np.arange(0, p.size, p.shape[1]) + goals] -= 1 / n

    for at in range(0, n, block):
        some = slice(at, at + block)
        p = h1[some] @ wc
        if large:
            np.minimum(p, 80, out=p)  # in single precision exp has no more room
        less_the_goals(p, cls[some])
        np.matmul(p, net.wc.T, out=dh[some])
        dwc += h1[some].T @ p
    order = np.argsort(y.astype(np.int16), kind="stable")
    ends = np.searchsorted(y[order], np.arange(0, HEAD + 1, HEAD_CLASS))
    order = order[: ends[-1]]
    h1, goals = h1[order], y[order] % HEAD_CLASS
    bo = net.bo.reshape(-1, HEAD_CLASS)
    wo, dwo = np.column_stack([net.wo, (bo - bo.max(1, keepdims=True)).reshape(-1)]), np.zeros((HEAD, H + 1), kind)
    groups = [(slice(ends[k], ends[k + 1]), slice(k * HEAD_CLASS, (k + 1) * HEAD_CLASS)) for k in np.flatnonzero(np.diff(ends))]
    q, dhs = np.empty((len(order), HEAD_CLASS), kind), np.empty((len(order), H), kind)
    for some, part in groups:
        np.matmul(h1[some], wo[part].T, out=q[some])
    for at in range(0, len(order), block):
        less_the_goals(q[at : at + block], goals[at : at + block])
    for some, part in groups:
        np.matmul(q[some], net.wo[part], out=dhs[some])
        np.matmul(q[some].T, h1[some], out=dwo[part])
    dh[order] += dhs
    return dh, dwc[:H], dwc[H], dwo[:, :H], dwo[:, H]


def gradients(net: Network, unit: np.ndarray, goal: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Gradients, in the order of parameters(), of the mean of -ln P(goal) over a window (steps, streams) that starts in
    state h and is in state zero where `fresh` says so; and the state after it."""
    steps, streams = unit.shape
    H, kind = HIDDEN, net.x.dtype
    x, u = net.gates()
    begin = [np.flatnonzero(f) for f in fresh]
    flat = unit.reshape(-1)
    a = x.take(flat, axis=1).reshape(3, steps, streams, H)
    was, after, update = (np.empty((steps, streams, H), kind) for _ in range(3))
    # what a change of the state is multiplied by to give those of the inputs of gate `new` (its x part), of `update`, of
    # `reset` and of the h part of `new`
    factor = np.empty((4, steps, streams, H), kind)
    g, rest = np.empty((3, streams, H), kind), np.empty((streams, H), kind)
    zr, linear = g[:2], g[2]
    with np.errstate(over="ignore"):
        for s in range(steps):
            was[s] = h
            was[s][begin[s]] = 0
            np.matmul(was[s], u, out=g)
            zr += a[:2, s]
            z, r = _sigmoid(zr)
            update[s] = z
            new = np.multiply(r, linear, out=after[s])
            new += a[2, s]
            np.tanh(new, out=new)
            into_new, into_update, into_reset, into_linear = (f[s] for f in factor)
            np.subtract(1, z, out=rest)
            np.multiply(rest, z, out=into_update)
            np.multiply(new, new, out=into_new)
            np.subtract(1, into_new, out=into_new)
            into_new *= rest
            np.multiply(into_new, r, out=into_linear)
            np.subtract(1, r, out=into_reset)
            into_reset *= linear
            into_reset *= into_linear
            np.subtract(was[s], new, out=rest)
            into_update *= rest
            rest *= z
            h = np.add(new, rest, out=after[s])
    dh, *outputs = output_gradients(net, after.reshape(-1, H), goal.reshape(-1))
    dh = dh.reshape(steps, streams, H)
    back, carry, parts = np.ascontiguousarray(u.swapaxes(1, 2)), np.zeros((streams, H), kind), g
    for s in range(steps - 1, -1, -1):
        d = dh[s]
        d += carry
        changes = factor[:, s]
        changes *= d
        np.matmul(changes[1:], back, out=parts)
        np.multiply(d, update[s], out=carry)
        for part in parts:
            carry += part
        carry[begin[s]] = 0
    found = factor.reshape(4, -1, H)
    du = np.matmul(was.reshape(-1, H).T, found[1:])
    new, update, reset = found[:3]
    return [sums_by_unit(np.concatenate([update, reset, new], 1), flat, len(net.x)), np.concatenate(list(du), 1), *outputs], h


def sums_by_unit(rows: np.ndarray, unit: np.ndarray, units: int, several: int = 16) -> np.ndarray:
    """Sums of the rows of each unit. Of all units the first rows are added at once, then the second ones, up to `several`;
    few units have more."""
    out = np.zeros((units, rows.shape[1]), rows.dtype)
    order, times = np.argsort(unit.astype(np.int16), kind="stable"), np.bincount(unit, minlength=units)
    first, frequent, ones = np.cumsum(times) - times, np.argsort(-times, kind="stable"), np.ones(len(unit), rows.dtype)
    more = np.searchsorted(-times[frequent], -np.arange(several + 1), "left")  # how many units have more than 0, 1, ... rows
    frequent, first = frequent[: more[0]], first[frequent[: more[0]]]
    sums = rows.take(order[first], axis=0)
    for k, n in enumerate(more[1:several], 1):
        sums[:n] += rows.take(order[first[:n] + k], axis=0)
    for i in range(more[several]):
        rest = order[first[i] + several : first[i] + times[frequent[i]]]
        sums[i] += ones[: len(rest)] @ rows.take(rest, axis=0)
    out[frequent] = sums
    return out


class Adam:
    """Adam with a rate that falls to nothing over `total` steps; parameters are changed in place. Its two averages are kept
    as sums of falling powers, without their constant factors."""

    def __init__(self, parameters: list[np.ndarray], rate: float, total: int):
        self.parameters, self.rate, self.total, self.t = parameters, rate, total, 0
        self.first, self.second, self.spare = ([np.zeros_like(p) for p in parameters] for _ in range(3))

    def step(self, found: list[np.ndarray]) -> None:
        self.t += 1
        step = self.rate * (1 - self.t / (self.total + 1)) * math.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t) * 0.1 / math.sqrt(0.001)
        for p, g, m, v, spare in zip(self.parameters, found, self.first, self.second, self.spare, strict=True):
            if max(g.max(), -g.min()) > 0.1:
                np.clip(g, -0.1, 0.1, out=g)
            m *= 0.9
            m += g
            v *= 0.999
            v += np.multiply(g, g, out=spare)
            np.sqrt(v, out=spare)
            spare += 1e-7 / math.sqrt(0.001)
            np.divide(m, spare, out=spare)
            spare *= step
            p -= spare


def train(net: Network, documents: list[np.ndarray], streams: int = 64, window: int = 32, epochs: int = 3, rate: float = 0.01) -> Network:
    """Truncated backpropagation through time; documents are arrays of units, end token included. They are joined to
    parallel streams; the state runs on from window to window and starts afresh with each document."""
    if not documents:
        return net
    length = max(1, math.ceil(sum(map(len, documents)) / streams / window)) * window
    adam = Adam(net.parameters(), rate, epochs * length // window)
    end, rng = documents[0][-1], np.random.default_rng(9)
    for _ in range(epochs):
        order = rng.permutation(len(documents))
        flat = np.concatenate([documents[i] for i in order])
        begins = np.zeros(len(flat), bool)
        begins[np.r_[0, np.cumsum([len(documents[i]) for i in order])[:-1]]] = True
        flat, begins = (np.resize(x, length * streams).reshape(streams, length).T for x in (flat, begins))
        before = np.where(begins, end, np.r_[np.full((1, streams), end), flat[:-1]])
        h = np.zeros((streams, HIDDEN), net.x.dtype)
        for at in range(0, length, window):
            some = slice(at, at + window)
            found, h = gradients(net, before[some], flat[some], begins[some], h)
            adam.step(found)
    return net


def score_units(net: Network, units: np.ndarray, ends: np.ndarray, end_unit: int, block: int = 1 << 16) -> np.ndarray:
    """Natural log-probabilities of documents whose units lie one after another; the state runs through each whole
    document while shorter ones drop out."""
    starts = np.r_[0, ends[:-1]]
    order = np.argsort(-(ends - starts), kind="stable")
    starts, sizes = starts[order], (ends - starts)[order]
    total = np.zeros(len(ends))
    h = np.zeros((len(ends), HIDDEN), np.float32)
    previous = np.full(len(ends), end_unit)
    gates = net.gates()
    states, goals, owners, held = [], [], [], 0
    alive = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), "right")

    def flush():
        nonlocal held
        if held:
            p = net.log_probability(np.concatenate(states), np.concatenate(goals))
            total[:] += np.bincount(np.concatenate(owners), p, len(total))
            for x in (states, goals, owners):
                x.clear()
            held = 0

    for t, n in enumerate(alive):
        h = net.step(previous[:n], h[:n], gates)
        goal = units.take(starts[:n] + t)
        states.append(h)
        goals.append(goal)
        owners.append(np.arange(n))
        held += n
        previous = goal
        if held >= block:
            flush()
    flush()
    out = np.empty(len(ends))
    out[order] = total
    return out


def learn(docs: DataFrame, voc: Vocabulary, sample_docs: int) -> Network:
    """docs: doc_id, text (training documents)."""
    chosen = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).select(F.col("doc_id").alias("__id"))
    chosen = materialize(chosen, "sample")
    same = F.col("doc_id").eqNullSafe(F.col("__id"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            units = []
            for tokens, ends in token_rows(b.column(1)):
                units += np.split(voc.units(tokens, *voc.find(tokens)), ends[:-1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(units, pa.list_(pa.int32()))], ["doc_id", "units"])

    found = docs.join(F.broadcast(chosen), same).select("doc_id", "text")  # sample_docs bounds it
    found = found.mapInArrow(batches, "doc_id bigint, units array<int>").toArrow().sort_by("doc_id")
    net = train(Network.start(voc), [x.values.to_numpy() for x in found.column("units").combine_chunks()])
    if chosen.count() < sample_docs:
        return net  # it was all
    others = docs.join(F.broadcast(chosen), same, "left_anti")
    for k in range(ROUNDS):
        share = others.filter(F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)) == k).select("text")
        net = refine(net, share, voc, 0.006 / (k + 1))
    return net


def occurrences(units: np.ndarray) -> np.ndarray:
    """All tokens, those of each unit and those of each class of head words."""
    each = np.bincount(units, minlength=HEAD + TAIL)
    return np.concatenate([[len(units)], each, each[:HEAD].reshape(-1, HEAD_CLASS).sum(1)]).astype(float)


def weights_of(seen: np.ndarray) -> list[np.ndarray]:
    """What occurrences count for in each of a network's parameters, rows of x by their unit, of wo and bo by their class."""
    all_, unit, head = seen[:1], seen[1 : 1 + HEAD + TAIL], np.repeat(seen[1 + HEAD + TAIL :], HEAD_CLASS)
    return [unit[:, None], all_[:, None], all_[:, None], all_, head[:, None], head]


def refine(net: Network, docs: DataFrame, voc: Vocabulary, rate: float) -> Network:
    """net after every row of docs (text) was trained on once: partitions train apart, their changes are averaged."""
    before = net.parameters()
    size = 1 + HEAD + TAIL + HEAD // HEAD_CLASS

    def changes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen, held, n = Network(*(p.copy() for p in before), net.tail_log), np.zeros(size), [], 0

        def learn_held():
            if held:
                train(own, held, streams=256, epochs=1, rate=rate)

        for b in it:
            for tokens, ends in token_rows(b.column(0)):
                units = voc.units(tokens, *voc.find(tokens))
                seen += occurrences(units)
                held += np.split(units, ends[:-1])
                n += len(units)
                if n >= BLOCK_TOKENS:
                    learn_held()
                    held, n = [], 0
        learn_held()
        if seen[0]:
            total = [seen, *((w * (a - b)).reshape(-1) for w, a, b in zip(weights_of(seen), own.parameters(), before, strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([np.concatenate(total).astype(np.float32).tobytes()], pa.binary())], ["k", "s"])

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((k, s) for b in it for k, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        if rows:
            total = sum(np.frombuffer(s, np.float32).astype(float) for _, s in rows)
            yield pa.RecordBatch.from_arrays([pa.array([rows[0][0]], pa.int32()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["k", "s"])

    n = max(1, math.ceil(voc.total / PART_TOKENS))
    parts = docs.coalesce(n).mapInArrow(changes, "k int, s binary")
    for fewer in (min(64, math.ceil(n / 16)), 1):
        parts = parts.repartition(fewer).mapInArrow(add, "k int, s binary")
    rows = parts.collect()  # one row
    if not rows:
        return net
    total = np.frombuffer(rows[0]["s"], np.float32)
    at, after = size, []
    for p, w in zip(before, weights_of(total[:size]), strict=True):
        after.append(p + total[at : at + p.size].reshape(p.shape) / np.maximum(w, np.float32(1)))
        at += p.size
    return Network(*after, net.tail_log)


def score(docs: DataFrame, allowed: Column, sample_docs: int = 1000) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of each row of docs (doc_id, text); allowed says
    which rows may be learnt from."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    train_docs = rows.filter(allowed).select("doc_id", "text")
    counts = materialize(count_tokens(train_docs), "counts")
    voc = vocabulary(counts)
    net = learn(train_docs, voc, sample_docs)
    base = math.log10(voc.total + voc.distinct + 1)
    end = np.array([END])
    end_unit = int(voc.units(end, *voc.find(end))[0])
    head_log = np.zeros(len(voc.token))
    is_tail = voc.unit >= HEAD
    head_log[is_tail] = voc.log_count[is_tail]  # what the tail classes' share leaves to the word

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            held, sizes, known_of, base_of, model_of, rare, times = [], [], [], [], [], [], []
            for tokens, ends in token_rows(b.column(2)):
                at, known = voc.find(tokens)
                n = np.diff(np.r_[0, ends])
                doc = np.repeat(np.arange(len(n)), n)
                place, owner = at[known], doc[known]
                known_of.append(np.bincount(owner, minlength=len(n)))
                base_of.append(np.bincount(owner, voc.log_count[place], len(n)) - n * base)
                model_of.append(np.bincount(owner, head_log[place], len(n)))
                found, several = distinct_by_row(doc[~known], tokens[~known], len(n))
                rare += found
                times += several
                held.append(voc.units(tokens, at, known))
                sizes.append(n)
            whole = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
            n = whole(sizes)
            lm = score_units(net, whole(held), np.cumsum(n), end_unit) / math.log(10) + whole(model_of)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n.astype(np.int64)), pa.array(whole(known_of).astype(np.int64)), pa.array(whole(base_of).astype(float)), pa.array(lm.astype(float)), pa.array(rare, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32()))],
                ["row", "doc_id", "n_tokens", "n_known", "base_score", "score", "rare", "times"],
            )

    scored = materialize(rows.mapInArrow(batches, "row bigint, doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double, rare array<bigint>, times array<int>"), "scored")
    # counts of the tokens that no worker knows; in a large vocabulary most of them are there. A document brings each once
    rest = scored.filter(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "times")).alias("t")).select("row", "t.rare", "t.times")
    rest = rest.join(counts.select("token", "c"), F.col("rare") == F.col("token"))
    rest = rest.groupBy(F.col("row").alias("__row")).agg(F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("logs"), F.sum("times").alias("found"))
    logs = F.coalesce("logs", F.lit(0.0))
    return scored.join(rest, F.col("row") == F.col("__row"), "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(voc.total).cast("bigint").alias("train_tokens"),
        (F.col("base_score") + logs).alias("base_score"), (F.col("score") + logs).alias("score"),
    )
