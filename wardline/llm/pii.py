"""Operator 3: personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans (email, ip, card, phone). In documents that have any, tokens that could be personal data
in another spelling (a number with other separators or without its prefix, an address without its top-level domain)
become nodes of a conditional random field with the base spans. Nodes have features of their shape, their digits and
separators, the word before them and the pattern evidence; neighbours in the text share a chain potential; distant tokens with the same or a similar core (the last seven
digits, the part before the at sign) share a skip potential. Loopy sum-product passing then decides what else is labelled,
consistently over the document. Base spans are evidence and always stay.

Weights are trained here by pseudo-likelihood on a bounded sample; half of the evidence is hidden while training. Copies of
base tokens without evidence are added: linked ones keep the label, lone ones lose it, so that shape alone adds no span.

Every pattern is scanned in time linear in the text. A batch of documents is one graph, so message passing is numpy over
all its edges; occurrences of a core are linked in a row, not pairwise, so edges are linear in the tokens.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NUMBER_RUN = re.compile(r"[0-9 ().-]{7,}")
_AT_END = re.compile(r"[A-Za-z0-9.-]*")
_WORD_BEFORE = re.compile(r"([^\W\d_]+)[\W\d_]*\Z")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) in code points, by start, then kind; matches of a kind never overlap."""
    found = [(a, b, 0) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((m.start(), m.end(), 1))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append((m.start(), m.end(), 3))
    found.sort(key=lambda s: (s[0], s[2]))
    return found


def render(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


# Nodes: the base spans, then other tokens that might be the same data.


def _shape(token: str) -> int:
    if "@" in token:
        return 0
    n = sum("0" <= c <= "9" for c in token)
    if token.count(".") == 3 and all(p.isdigit() for p in token.split(".")):
        return 1
    return 2 if n >= 12 else 3 if n >= 9 else 4 if n >= 7 else 5


N_SHAPES = 6
BATCH_NODES = 4096
EVIDENCE = slice(1 + N_SHAPES, 1 + N_SHAPES + len(KINDS))
N_WORDS, N_SEPARATORS, N_LENGTHS = 16, 8, 10  # buckets of the word before a token, of its separators, of its digits
N_FEATURES = EVIDENCE.stop + N_WORDS + N_SEPARATORS + N_LENGTHS


def _context(text: str, a: int, b: int) -> tuple[int, int, int]:
    """Buckets of what stands before a token and of how it is written."""
    before = _WORD_BEFORE.search(text[max(0, a - 24) : a])
    word = 1 + zlib.crc32(before[1].lower().encode()) % (N_WORDS - 1) if before else 0
    token = text[a:b]
    marks = sum(1 << i for i, c in enumerate(" -.(") if c in token)
    digits = sum("0" <= c <= "9" for c in token)
    return word, marks % N_SEPARATORS, min(digits // 2, N_LENGTHS - 1)


def _core(token: str, kind: int | None) -> str:
    if "@" in token:
        return "@" + token[: token.index("@")].lower()
    if kind == 1 or (kind is None and _shape(token) == 1):
        return "i" + ".".join(p.lstrip("0") or "0" for p in token.split("."))
    return "n" + "".join(c for c in token if "0" <= c <= "9")[-7:]


def _at_words(text: str):
    """Places of at signs with what could be an address around them, each from where the one before ended."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        done = at + 1
        if start < at:
            done = _AT_END.match(text, at + 1).end()
            yield start, done
        at = text.find("@", done)


def _number_tokens(text: str):
    """Places of digits with spaces, dots, hyphens and parentheses between them: seven characters or more, from a digit or
    an opening parenthesis to a digit."""
    for m in _NUMBER_RUN.finditer(text):
        run = m[0]
        a, b = m.end() - len(run.lstrip(" ).-")), m.start() + len(run.rstrip(" ().-"))
        if b - a >= 7:
            yield a, b


def nodes_of(text: str, base: list[tuple[int, int, int]]):
    """(start, end, kind or None, shape, core, context) of the base spans and of what else could be personal data."""
    out = [(a, b, k, _shape(text[a:b]), _core(text[a:b], k), _context(text, a, b)) for a, b, k in base]
    taken = sorted((a, b) for a, b, _ in base)
    ends, high = [], 0
    for _, b in taken:
        high = max(high, b)
        ends.append(high)
    starts = np.array([a for a, _ in taken])
    ends = np.array(ends)
    for find in (_at_words, _number_tokens):
        for a, b in find(text):
            i = int(np.searchsorted(starts, b))  # base spans that start before this one ends
            if i and ends[i - 1] > a:
                continue
            token = text[a:b]
            if find is _number_tokens and sum("0" <= c <= "9" for c in token) < 7:
                continue
            out.append((a, b, None, _shape(token), _core(token, None), _context(text, a, b)))
    out.sort(key=lambda x: (x[0], x[1], -1 if x[2] is None else x[2]))
    return out


def _edges(nodes, offset: int, chain, skip, near: int = 40) -> None:
    """Neighbours within `near` characters, and each token with the last one of the same core."""
    last: dict[str, int] = {}
    for i, x in enumerate(nodes):
        if i and x[0] - nodes[i - 1][1] <= near:
            chain.append((offset + i - 1, offset + i))
        if x[4] in last:
            skip.append((offset + last[x[4]], offset + i))
        last[x[4]] = i


def _feature_rows(nodes) -> np.ndarray:
    f = np.zeros((len(nodes), N_FEATURES))
    for i, (_, _, kind, shape, _, (word, marks, digits)) in enumerate(nodes):
        f[i, 0] = f[i, 1 + shape] = 1
        if kind is not None:
            f[i, EVIDENCE.start + kind] = 1
        at = EVIDENCE.stop
        f[i, at + word] = f[i, at + N_WORDS + marks] = f[i, at + N_WORDS + N_SEPARATORS + digits] = 1
    return f


@dataclass
class SkipChainModel:
    """unary: features by labels; chain: labels by labels; skip: gain where two linked tokens agree on a kind."""

    unary: np.ndarray
    chain: np.ndarray
    skip: float

    @staticmethod
    def start() -> SkipChainModel:
        unary = np.zeros((N_FEATURES, LABELS))
        unary[0, 0] = 1.0
        for k in range(len(KINDS)):
            unary[EVIDENCE.start + k, 1 + k] = 5.0
        return SkipChainModel(unary, np.zeros((LABELS, LABELS)), 2.5)

    def skip_table(self) -> np.ndarray:
        table = np.eye(LABELS) * self.skip
        table[0, 0] = 0.0  # that both are nothing is no agreement
        return table

    def marginals(self, f: np.ndarray, chain: np.ndarray, skip: np.ndarray, rounds: int = 12, damping: float = 0.3) -> np.ndarray:
        """Beliefs of all nodes by loopy sum-product; every graph of a batch at once."""
        own = f @ self.unary
        own[:, 1:] += 20.0 * f[:, EVIDENCE]  # base spans stay
        edges = np.concatenate([chain, skip]) if len(chain) + len(skip) else np.zeros((0, 2), np.int64)
        if len(edges):
            src = np.concatenate([edges[:, 0], edges[:, 1]])
            dst = np.concatenate([edges[:, 1], edges[:, 0]])
            back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
            is_chain = np.arange(len(edges)) < len(chain)
            tables = np.where(is_chain[:, None, None], self.chain[None], self.skip_table()[None])
            tables = np.concatenate([tables, tables.transpose(0, 2, 1)])  # [edge, label of src, label of dst]
            msg = np.zeros((len(src), LABELS))
            for _ in range(rounds):
                belief = own.copy()
                np.add.at(belief, dst, msg)
                cavity = belief[src] - msg[back]
                z = cavity[:, :, None] + tables
                top = z.max(1)
                new = top + np.log(np.exp(z - top[:, None, :]).sum(1))
                new -= new.max(1, keepdims=True)
                msg = damping * msg + (1 - damping) * new
            np.add.at(own, dst, msg)
        own = own - own.max(1, keepdims=True)
        p = np.exp(own)
        return p / p.sum(1, keepdims=True)


def _assemble(node_lists):
    chain, skip, rows, at = [], [], [], 0
    for nodes in node_lists:
        _edges(nodes, at, chain, skip)
        rows.append(_feature_rows(nodes))
        at += len(nodes)
    pairs = lambda x: np.array(x, np.int64).reshape(-1, 2)
    return (np.concatenate(rows) if rows else np.zeros((0, N_FEATURES))), pairs(chain), pairs(skip)


def fit(node_lists, steps: int = 300, rate: float = 1.0, pull: float = 0.005, seed: int = 3) -> SkipChainModel:
    """Pseudo-likelihood with hidden evidence, drawn towards the start values (all there is without data)."""
    model, prior = SkipChainModel.start(), SkipChainModel.start()
    rng = np.random.default_rng(seed)
    lists = []
    for nodes in node_lists:
        cores = {x[4]: 1 + x[2] for x in nodes if x[2] is not None}
        # Without evidence but of a base token's core: taken for the same where it is a neighbour, itself not learned from.
        lists.append([(*x, cores.get(x[4], 0) if x[2] is None else 1 + x[2], float(x[2] is not None or x[4] not in cores)) for x in nodes])
        for i, (_, _, k, s, core, context) in enumerate(nodes):
            if k is not None:
                # Without evidence a token of the same shape is the same data beside its like, and none when alone.
                lists.append([(0, 1, k, s, core, context, 1 + k, 1.0), (10**6, 10**6 + 1, None, s, core, context, 1 + k, 1.0)])
                lists.append([(0, 1, None, s, f"lone{i}", context, 0, 1.0)])
    f, chain, skip = _assemble([[x[:6] for x in nodes] for nodes in lists])
    if not len(f):
        return model
    y = np.array([x[6] for nodes in lists for x in nodes])
    counts = np.array([x[7] for nodes in lists for x in nodes])
    one_hot = np.eye(LABELS)[y]
    src = np.concatenate([chain[:, 0], chain[:, 1]])
    dst = np.concatenate([chain[:, 1], chain[:, 0]])
    s_src, s_dst = np.concatenate([skip[:, 0], skip[:, 1]]), np.concatenate([skip[:, 1], skip[:, 0]])
    for _ in range(steps):
        g = f.copy()
        g[rng.random(len(g)) < 0.5, EVIDENCE] = 0
        z = g @ model.unary
        if len(src):
            np.add.at(z, dst, model.chain[y[src]])
        if len(s_src):
            np.add.at(z, s_dst, model.skip_table()[y[s_src]])
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = (one_hot - p) * counts[:, None] / len(g)
        model.unary += rate * (g.T @ d - pull * (model.unary - prior.unary))
        if len(src):
            grad = np.zeros_like(model.chain)
            np.add.at(grad, y[src], d[dst])
            model.chain += rate * ((grad + grad.T) / 2 - pull * model.chain)
        if len(s_src):
            gain = float(sum(d[t, y[s]] for s, t in zip(s_src, s_dst) if y[s]))
            model.skip += rate * (gain - pull * (model.skip - prior.skip))
    model.skip = max(model.skip, 0.0)
    return model


def train_model(docs: DataFrame, most_docs: int = 400, most_bytes: int = 16384) -> SkipChainModel:
    """Fits on at most `most_docs` documents with digits or at signs and at most `most_bytes` bytes, the first by hash."""
    some = docs.select("doc_id", "text").where(F.col("text").rlike(r"@|\+[0-9]|[0-9]{4}|[0-9]\.[0-9]") & (F.octet_length("text") <= most_bytes))
    # Hashes alone are ranked, so that tasks send numbers and the texts of the chosen few are fetched by them.
    chosen = some.select(F.xxhash64("doc_id", "text").alias("h")).distinct().orderBy("h").limit(most_docs)
    every = docs.select(F.xxhash64("doc_id", "text").alias("h"), "text")
    rows = every.join(F.broadcast(chosen), "h").groupBy("h").agg(F.min("text").alias("text")).collect()  # rows that repeat are one
    texts = sorted((r["h"], r["text"]) for r in rows)
    lists = [nodes_of(t, b) for _, t in texts if (b := base_spans(t))]
    return fit(lists)


def find_spans(texts: list[str], model: SkipChainModel, sure: float = 0.8):
    """For each text its base spans and all its spans, each by start, then kind."""
    base = [base_spans(t) for t in texts]
    lists, owners = [], []
    for i, (t, b) in enumerate(zip(texts, base)):
        nodes = nodes_of(t, b)
        if len(nodes) > max(len(b), 1):  # a lone token has nothing to support it
            lists.append(nodes)
            owners.append(i)
    every = [list(b) for b in base]
    at = 0
    while at < len(lists):
        # A few thousand tokens at a time, so that memory follows the longest text; graphs are apart from each other.
        upto, n = at + 1, len(lists[at])
        while upto < len(lists) and n + len(lists[upto]) <= BATCH_NODES:
            n += len(lists[upto])
            upto += 1
        p = model.marginals(*_assemble(lists[at:upto]))
        first = 0
        for i, nodes in zip(owners[at:upto], lists[at:upto]):
            for x, q in zip(nodes, p[first : first + len(nodes)]):
                k = int(q.argmax())
                if x[2] is None and k and q[k] >= sure:
                    every[i].append((x[0], x[1], k - 1))
            every[i].sort(key=lambda s: (s[0], s[2]))
            first += len(nodes)
        at = upto
    return base, every


SCHEMA = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"


def _pieces(column, rows: int = 256):
    """A few rows at a time, so that memory follows the longest texts and not the batch."""
    for i in range(0, len(column), rows):
        yield i, [t or "" for t in column.slice(i, rows).to_pylist()]


def find_personal_data(docs: DataFrame, model: SkipChainModel) -> DataFrame:
    """One row for each document. Null texts count as empty; repeated rows are rows of their own; empty input, empty result.

    n_* and base_sha256 count the base spans; spans has them and what the model adds, n_added says how many it added.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            ids, text = b.column(0), b.column(1)
            for at, texts in _pieces(text):
                base, every = find_spans(texts, sent.value)
                counts = np.array([[sum(s[2] == k for s in x) for k in range(len(KINDS))] for x in base], np.int64).reshape(-1, len(KINDS))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, len(texts)).cast(pa.int64()),
                        *[pa.array(counts[:, k]) for k in range(len(KINDS))],
                        pa.array([hashlib.sha256(render(x).encode()).hexdigest() for x in base]),
                        pa.array([render(x) for x in every]),
                        pa.array([len(x) - len(y) for x, y in zip(every, base)], pa.int64()),
                    ],
                    ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
                )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, SCHEMA)


def mask(text: str, spans) -> str:
    """The text with each run of overlapping spans replaced by the kind of its first one, in angle brackets."""
    out, at, until = [], 0, 0
    for a, b, k in spans:
        if a >= until:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        until = max(until, b)
        at = until
    return "".join([*out, text[at:]])


def mask_documents(docs: DataFrame, model: SkipChainModel) -> DataFrame:
    """docs with personal data in text replaced; documents without any, and other columns, stay as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    where = docs.columns.index("text")

    def run(batches):
        for b in batches:
            column = b.column(where)
            for at, texts in _pieces(column):
                _, every = find_spans(texts, sent.value)
                part = b.slice(at, len(texts))
                old = part.column(where).to_pylist()
                new = [mask(t, s) if s else o for t, s, o in zip(texts, every, old)]
                columns = list(part.columns)
                columns[where] = pa.array(new, pa.string())
                yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op3_pii_skip_chain(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", even=True)
    return find_personal_data(docs, train_model(docs))
