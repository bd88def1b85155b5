"""Alignment of two tokenizers' tokens over the same bytes.

Both tokenizers encode each text. Words come again and again, so a text is cut at single spaces between other characters, which no token of either
vocabulary crosses, and a worker encodes each stretch once while it remembers it; a text whose stretches aren't all given back is encoded whole. An Arrow function returns the ids, the place of each token's last byte, and its number of bytes. All else is Spark's
higher-order functions: ``array_intersect`` of the ends gives the bytes where tokens of both end, which cut them into groups; ``transform``,
``array_repeat`` and ``flatten`` give the token that covers each byte, so that the last tokens of a group are looked up in one step and work
stays linear in the text. Bulk functions and lambdas are in selects of their own, each with a column that the next one reads twice: so the
optimizer keeps them apart, and nothing bulky is computed anew for each element. The two tokens that end together are linked; links of a pair of ids are counted over the corpus, and each link of a
document is held against the count of its pair and the highest of its B id.

Counts are summed to one row for each task and pair before the shuffle. They are sent to all executors if they fit; else the pairs
that hold a thousandth of all links each (a thousand at most) are, and the others, none of which is hot, meet by a shuffle.

Rows: texts that are null or empty, or that a tokenizer doesn't give back byte for byte, have no tokens, groups or links; texts are read whole;
repeated rows are aligned alike and count each; an empty table gives none. The result's columns are fixed, so others can't clash. Tokens have
one byte at least, as both vocabularies do, which is checked as they are loaded.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .hashing import buffers, chunks
from .store import BROADCAST_BYTES, Scratch, lean_workers

#: Fixed value: the pattern that splits text before the merges of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space beyond which the pattern is left to the slower library, as the faster one runs out of stack.
LONG_GAP = re.compile(r"\s{50000}")
#: Where texts are cut: at a space with no white space on either side, where words of both tokenizers begin.
CUT = re.compile(r" (?=\S)(?<=\S )")
#: Bytes of text whose different stretches are encoded together, and stretches that are encoded as one text: long ones take longer a byte.
PIECE, TOGETHER = 1 << 22, 1000
#: Stretches that a worker remembers.
MOST = 1 << 18
_TOKENS = "a array<int>, a_last array<int>, a_size array<int>, b array<int>, b_last array<int>, b_size array<int>"


# -- tokenising --------------------------------------------------------------------------------------------------------


def _byte_alphabet() -> dict[str, int]:
    """The printable character for each byte of a byte-level vocabulary: printable Latin-1 for itself, others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Bytes:
    """A byte-level vocabulary file: ids and bytes of its tokens.

    Where the file's merges make the tokens in the order of their ids, which is checked, a rank encoder gives the same ids several times faster.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, vocab = _byte_alphabet(), spec["model"]["vocab"]
        ranks = {bytes(alphabet[c] for c in token): i for token, i in vocab.items()}
        size = max(max(vocab.values()), max((t["id"] for t in spec["added_tokens"]), default=0)) + 1
        self.bytes: list[bytes] = [b""] * size
        for t in spec["added_tokens"]:
            self.bytes[t["id"]] = t["content"].encode()
        for b, i in ranks.items():
            self.bytes[i] = b
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        plain = spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and spec["normalizer"] is None
        ordered = [vocab["".join(p)] for p in pairs] == list(range(len(vocab) - len(pairs), len(vocab)))
        #: whether each stretch that ``CUT`` leaves is encoded alike alone and in its text
        self.apart = plain
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if plain and ordered else None

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None and not LONG_GAP.search(text):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


class Pieces:
    """A piece model: ids and bytes of its pieces."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        byte = re.compile("<0x([0-9A-F]{2})>")
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(m[1], 16)]) if (m := byte.fullmatch(p)) else p.replace("\u2581", " ").encode() for p in names]
        self.apart = self._apart(names)

    def _apart(self, names: list[str]) -> bool:
        """Whether each stretch that ``CUT`` leaves is encoded alike alone and in its text: merges of pairs, none across the beginning of a word."""
        try:
            from sentencepiece import sentencepiece_model_pb2
        except ImportError:
            return False
        spec = sentencepiece_model_pb2.ModelProto.FromString(self.model.serialized_model_proto())
        rule, kinds = spec.normalizer_spec, type(spec.pieces[0]) if spec.pieces else None
        merged = spec.trainer_spec.model_type == sentencepiece_model_pb2.TrainerSpec.BPE and not spec.trainer_spec.treat_whitespace_as_suffix
        plain = rule.add_dummy_prefix and rule.escape_whitespaces and not rule.remove_extra_whitespaces and not rule.precompiled_charsmap
        own = any(p.type == kinds.USER_DEFINED for p in spec.pieces)
        return merged and plain and not own and not any(re.search("[^\u2581]\u2581", n) for n in names)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@cache
def _loaded(kind: type, path: str):
    found = kind(path)
    if not all(found.bytes):
        raise ValueError(f"{path} has tokens without bytes")
    found.length = np.array([len(b) for b in found.bytes], np.int64)
    return found


def _whole(stretch: str, a: Bytes, b: Pieces) -> tuple[np.ndarray, np.ndarray] | None:
    """Ids of both tokenizers for a stretch, before which a space stands; none if it isn't given back."""
    whole = (" " + stretch).encode()
    x, y = a.encode(" " + stretch), b.encode([stretch])[0]
    return (x, np.array(y, np.int32)) if a.length[x].sum() == len(whole) and b"".join(map(b.bytes.__getitem__, y)) == whole else None


def _encoded(stretches: list[str], a: Bytes, b: Pieces) -> tuple[list[np.ndarray], list[np.ndarray], list[bool]]:
    """Ids of both for all stretches one after the other, in parts, and which are given back; only those have ids.

    They are encoded as one text if they begin and end without white space; if that isn't given back, each half is encoded alone, and so on.
    """
    if not stretches:
        return [], [], []
    found = _whole(" ".join(stretches), a, b)
    if found is not None and len(stretches) > 1:
        ends = np.cumsum([len(s.encode()) + 1 for s in stretches])
        if not all(np.isin(ends, np.cumsum(v.length[ids])).all() for v, ids in zip((a, b), found, strict=True)):
            found = None
    if found is not None:
        return [found[0]], [found[1]], [True] * len(stretches)
    if len(stretches) == 1:
        return [], [], [False]
    half = len(stretches) // 2
    return tuple(x + y for x, y in zip(_encoded(stretches[:half], a, b), _encoded(stretches[half:], a, b), strict=True))


class Stretches:
    """The stretches that were met, by number, and where each one's tokens stand among all; forgotten when they are many."""

    def __init__(self, a: Bytes, b: Pieces) -> None:
        self.a, self.b = a, b
        self.cut = CUT.split if a.apart and b.apart else lambda text: [text]
        self.forget()

    def forget(self) -> None:
        none = np.zeros(0, np.int64)
        #: a text that was taken whole is a tuple, so that it isn't taken for a stretch
        self.number: dict[str | tuple[str], int] = {}
        self.size, self.good = none, none.astype(bool)
        self.ids, self.first, self.n = ([none] * 2 for _ in range(3))

    def places(self, texts: list[str | None]) -> list[np.ndarray]:
        """The numbers of each text's stretches; none for texts that are null, empty or not given back."""
        if len(self.number) > MOST or self.size.sum() > 4 * PIECE:
            self.forget()
        number, known = self.number, len(self.number)
        out = [np.array([number.setdefault(w, len(number)) for w in self.cut(t)] if t else [], np.int64) for t in texts]
        self._encode(list(islice(number, known, None)))
        if not self.good.all():
            # a text that holds a stretch that isn't given back is taken whole
            for i, p in enumerate(out):
                if not self.good[p].all():
                    whole = (texts[i],)
                    if whole not in number:
                        number[whole] = len(number)
                        self._add([texts[i]], *_encoded([texts[i]], self.a, self.b))
                    out[i] = np.array([number[whole]] if self.good[number[whole]] else [], np.int64)
        return out

    def _encode(self, names: list[str]) -> None:
        """Tokens of new stretches; those with white space at an end are encoded one by one, as they would not stay apart in a text."""
        odd = np.array([not w or w[0].isspace() or w[-1].isspace() for w in names], bool)
        by = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
        some, plain, found = [names[i] for i in by], int((~odd).sum()), ([], [], [])
        for lo, hi in (*((i, min(i + TOGETHER, plain)) for i in range(0, plain, TOGETHER)), *((i, i + 1) for i in range(plain, len(some)))):
            for col, v in zip(found, _encoded(some[lo:hi], self.a, self.b), strict=True):
                col += v
        self._add(some, *found, np.argsort(by))

    def _add(self, names: list[str], xs: list[np.ndarray], ys: list[np.ndarray], good: list[bool], order: np.ndarray | None = None) -> None:
        """Stretches with the next numbers, in an order of their own: their tokens are those up to their last byte that no earlier one has."""
        order, right = np.arange(len(names)) if order is None else order, np.array(good, bool)
        size = np.array([len(w.encode()) + 1 for w in names], np.int64)
        last = np.cumsum(np.where(right, size, 0))
        self.size, self.good = np.concatenate([self.size, size[order]]), np.concatenate([self.good, right[order]])
        for v, (coder, parts) in enumerate(zip((self.a, self.b), (xs, ys), strict=True)):
            ids = np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64)
            until = np.searchsorted(np.cumsum(coder.length[ids]), last, "right")
            n = np.diff(until, prepend=0)
            self.first[v] = np.concatenate([self.first[v], (until - n + len(self.ids[v]))[order]])
            self.n[v], self.ids[v] = np.concatenate([self.n[v], n[order]]), np.concatenate([self.ids[v], ids])


@cache
def _met(a_path: str, b_path: str) -> Stretches:
    return Stretches(_loaded(Bytes, a_path), _loaded(Pieces, b_path))


def _rows(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(np.int32)))


def tokens_of(texts: list[str | None], a_path: str, b_path: str) -> list[pa.ListArray]:
    """Ids, last bytes and sizes of both tokenizers; none for texts that are null, empty or not given back."""
    met, out = _met(a_path, b_path), []
    places = met.places(texts)
    flat = np.concatenate([np.zeros(0, np.int64), *places])
    upto = np.concatenate([[0], np.cumsum([len(p) for p in places])]).astype(np.int64)
    before = np.concatenate([[0], np.cumsum(met.size[flat])])
    for v, coder in enumerate((met.a, met.b)):
        n = met.n[v][flat]
        ends = np.concatenate([[0], np.cumsum(n)])
        x = met.ids[v][np.repeat(met.first[v][flat] - ends[:-1], n) + np.arange(ends[-1])]
        sizes, bounds = coder.length[x], ends[upto]
        lasts = np.cumsum(sizes) - 1 - np.repeat(before[upto[:-1]], np.diff(bounds))
        out += [_rows(c, bounds) for c in (x, lasts, sizes)]
    return out


def tokenise(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, key, a, a_last, a_size, b, b_last, b_size): a row of docs and its tokens; batches are cut to a piece of text at a time."""
    lean_workers(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, bounds = buffers(batch.column("text"))
            for i, j in chunks(bounds, PIECE):
                part = batch.slice(i, j - i)
                cols = tokens_of(part.column("text").to_pylist(), a_path, b_path)
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("key"), *cols], ["row", "key", *[c.split()[0] for c in _TOKENS.split(", ")]])

    return rows.mapInArrow(encode, f"row long, key {kind}, {_TOKENS}").withColumnRenamed("key", key)


# -- groups and links --------------------------------------------------------------------------------------------------


def meeting(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """(row, key, a, b, a_at, b_at): the ids, and for each byte where tokens of both end the places of these tokens."""
    over = lambda size: F.flatten(F.transform(size, lambda n, i: F.array_repeat(i, n)))
    bulk = tokens.select("row", key, "a", "b", F.array_intersect("a_last", "b_last").alias("ends"), over("a_size").alias("over_a"), over("b_size").alias("over_b"))
    at = lambda c: F.transform("ends", lambda e: F.get(c, e))
    return bulk.select("row", key, "a", "b", at("over_a").alias("a_at"), at("over_b").alias("b_at"))


def pair(a: Column, b: Column) -> Column:
    return F.shiftleft(a.cast("long"), 32) + b


def links(a: str = "a", b: str = "b", a_at: str = "a_at", b_at: str = "b_at") -> Column:
    """array<long>: the pair of ids of each link; tokens have bytes, so each place where both end has one."""
    return F.zip_with(a_at, b_at, lambda x, y: pair(F.get(a, x), F.get(b, y)))


def _before(at: str) -> Column:
    """The places before those of ``at``: -1, then all but the last."""
    return F.when(F.size(at) > 0, F.concat(F.array(F.lit(-1)), F.slice(at, 1, F.size(at) - 1))).otherwise(F.col(at))


def groups(met: DataFrame, key: str = "doc_id") -> DataFrame:
    """(row, key, n_a, n_b, groups): the ids of both up to each byte where both end, array<struct<a, b>>."""
    apart = met.select("row", key, "a", "b", "a_at", "b_at", _before("a_at").alias("a_from"), _before("b_at").alias("b_from"))
    part = lambda ids, before, at: F.zip_with(before, at, lambda p, x: F.slice(ids, p + 2, x - p))
    both = F.zip_with(part("a", "a_from", "a_at"), part("b", "b_from", "b_at"), lambda x, y: F.struct(x.alias("a"), y.alias("b")))
    return apart.select("row", key, F.size("a").cast("long").alias("n_a"), F.size("b").cast("long").alias("n_b"), both.alias("groups"))


def spelled(met: DataFrame, key: str = "doc_id") -> DataFrame:
    """(row, key, n_a, n_b, links, text): the groups as text, with ids of A, a bar and ids of B, and semicolons between groups."""
    ids = met.select("row", key, "a", "b", "a_at", "b_at", links().alias("links"), _before("a_at").alias("a_from"), _before("b_at").alias("b_from"))

    def part(ids_: str, before: str, at: str) -> Column:
        many = lambda p, x: F.array_join(F.slice(ids_, p + 2, x - p).cast("array<string>"), ",")
        one = lambda p, x: F.when(x - p == 1, F.get(ids_, x).cast("string")).otherwise(many(p, x))
        return F.zip_with(before, at, one)

    whole = F.array_join(F.zip_with(part("a", "a_from", "a_at"), part("b", "b_from", "b_at"), lambda x, y: F.concat(x, F.lit("|"), y)), ";")
    return ids.select("row", key, F.size("a").cast("long").alias("n_a"), F.size("b").cast("long").alias("n_b"), "links", whole.alias("text"))


def pair_counts(linked: DataFrame, col: str = "links") -> DataFrame:
    """(pair, times, best): links of each pair of ids over all rows, and whether no pair of the same B id has more.

    The window holds the pairs of one B id: at most as many as A has ids.
    """
    counted = linked.select(F.explode(col).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("times"))
    most = F.max("times").over(W.partitionBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))))
    return counted.select("pair", "times", (F.col("times") == most).alias("best"))


def held_against(linked: DataFrame, counts: DataFrame, row: str = "row", col: str = "links", most: int = BROADCAST_BYTES) -> DataFrame:
    """(row, n_best, count_sum) of the rows with links: links that are their B id's best, and the sum of all links' counts."""
    each = linked.select(row, F.explode(col).alias("pair"))
    if counts.count() * 40 <= most:
        met = each.join(F.broadcast(counts), "pair")
    else:
        total = counts.agg(F.sum("times")).first()[0]
        hot = counts.where(F.col("times") * 1000 >= total)  # a thousand rows at most
        cold = each.join(F.broadcast(hot), "pair", "left_anti").join(counts.where(F.col("times") * 1000 < total), "pair")
        met = each.join(F.broadcast(hot), "pair").unionByName(cold)
    return met.groupBy(row).agg(F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("times").alias("count_sum"))


def align(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, key, a, b, a_at, b_at) of each document: what ``groups``, ``links`` and ``digest`` are made of."""
    return meeting(tokenise(docs, a_path, b_path, key, text), key)


def digest(met: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): each document's alignment against the corpus's counts.

    Links and digests are written once; the counts and the documents' sums read them.
    """
    scratch = Scratch(met.sparkSession, "alignment")
    sha = F.when(F.size("links") > 0, F.sha2(F.col("text").cast("binary"), 256)).otherwise("")
    rows = scratch.cut(spelled(met, key).select("row", key, "n_a", "n_b", "links", sha.alias("groups_sha256")))
    sums = held_against(rows.select("row", "links"), scratch.cut(pair_counts(rows)))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    n = F.size("links").cast("long")
    out = rows.select("row", key, "n_a", "n_b", n.alias("n_groups"), n.alias("n_links"), "groups_sha256").join(sums, "row", "left")
    return out.select(key, "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
