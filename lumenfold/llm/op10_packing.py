"""Best-fit packing with bound-certified repacking.

Texts are encoded word by word: white space always ends a token and no step of the
tokenizer looks across it, so a worker keeps the ids of the words it has met (at most
`WORDS_KEPT`) and the tokenizer sees each of them once.  Longer documents than a sequence
give whole pieces, which fill one each; the rest are packed:

*   pieces are dealt into partitions of about `per_partition`;
*   each partition runs best-fit decreasing and computes the best of a family of
    dual-feasible-function bounds on its number of bins.  Where the two agree, its packing
    is certified and final;
*   a partition with a gap keeps its full bins and hands the pieces of its emptiest bins
    over, `exchanged` for each bin above the bound; `fan` such partitions meet in one, which
    packs again.  Where more is handed over than `per_partition` pieces for each of these,
    there are more of them, so no task grows with the input; a round that would have more
    than half the partitions of the one before is the last.

Null and empty texts are one piece: the closing id alone.  Every row of the input is packed,
repeated ids included (a null id stays null); an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from . import text as tx

CAPACITY = 4096
END = 1
WORDS_KEPT = 1_600_000
#: Longer words are encoded each time they occur.
WORD_BYTES = 64

_PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"
#: Signs that make one match of the tokenizer's pattern at the end of a word.
_SIGNS = b'.,!?;:#*$%&|()-"'


class _Words:
    """A tokenizer and the ids of the words that this worker has met, as bytes."""

    #: Lower-case ASCII and Latin-1 letters in UTF-8: one match of the tokenizer's pattern.
    plain = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.bare = None
        # the same merges without the steps that change nothing in plain words; a run of
        # words is encoded at once and cut behind the pieces that end a word
        shape = json.loads(self.full.to_str())
        suffix = shape["model"].get("end_of_word_suffix")
        if shape["model"]["type"] == "BPE" and suffix:
            ends = np.zeros(max(shape["model"]["vocab"].values()) + 1, bool)
            ends[[i for w, i in shape["model"]["vocab"].items() if w.endswith(suffix)]] = True
            shape |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "added_tokens": []}
            self.bare, self.ends = Tokenizer.from_str(json.dumps(shape)), ends
            # bytes that aren't printable stand for themselves from 256 on, as in the full tokenizer
            printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
            rest = [i for i in range(256) if i not in printable]
            self.stand = {b: 256 + n for n, b in enumerate(rest) if b != 32}
            probe = ["aber", "thening", "über", "école", "niño", "straße", "x"]
            got = self._plain([p.encode() for p in probe])
            if got != [np.array(self.full.encode(p, add_special_tokens=False).ids, "<u4").tobytes() for p in probe]:
                self.bare = None

    def _plain(self, words: list[bytes]) -> list[bytes]:
        runs = [b" ".join(words[i : i + 512]).decode("latin-1").translate(self.stand) for i in range(0, len(words), 512)]
        out: list[bytes] = []
        for at in range(0, len(runs), 64):
            ids = np.concatenate([np.array(e.ids, "<u4") for e in self.bare.encode_batch_fast(runs[at : at + 64], add_special_tokens=False)])
            cut = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip(cut, cut[1:])]
        return out

    def ids(self, words: list[bytes]) -> list[bytes]:
        plain = [bool(self.bare and self.plain(w)) for w in words]
        easy = iter(self._plain([w for w, p in zip(words, plain) if p]) if any(plain) else ())
        hard = [w for w, p in zip(words, plain) if not p]
        full: list[bytes] = []
        for at in range(0, len(hard), 4096):
            some = [w.decode() for w in hard[at : at + 4096]]
            full += [np.array(e.ids, "<u4").tobytes() for e in self.full.encode_batch_fast(some, add_special_tokens=False)]
        other = iter(full)
        return [next(easy) if p else next(other) for p in plain]


def _encoder(path: str) -> _Words:
    """This worker's words."""
    return common.held(("op10", path), lambda: _Words(path))


def encode(text: bytes, path: str) -> bytes:
    """The ids of one text, little-endian unsigned 32-bit, without the closing id."""
    return _encode_all([text], path)[0]


def _learn(words: list[bytes], encoder: _Words, known: dict[bytes, bytes]) -> None:
    """Puts the ids of these words into known.  A word that ends in signs after a plain letter
    or a digit has the ids of what stands before them, in lower case, and theirs."""
    made, ask = [], set()
    for w in words:
        core = w.rstrip(_SIGNS)
        low = core.lower()
        good = core[-1:].isalnum() and b"<" not in core  # special tokens are read as they stand
        if not core.isascii() and not encoder.plain(low):
            other = low.decode().lower().encode()
            low = other if encoder.plain(other) else low
        if good or encoder.plain(low):
            tail = w[len(core) :]
            ask.add(low)
            if tail or low != w:
                made.append((w, low, tail))
                ask.add(tail)
        else:
            ask.add(w)
    ask.discard(b"")
    fresh = [w for w in ask if w not in known]
    known.update(zip(fresh, encoder.ids(fresh)))
    for w, low, tail in made:
        known[w] = known[low] + known[tail] if tail else known[low]


def _encode_all(texts: list[bytes], path: str) -> list[bytes]:
    encoder = _encoder(path)
    known = encoder.known
    split = [t.split() for t in texts]
    seen: set[bytes] = set()
    for ws in split:
        seen.update(ws)
    new = [w for w in seen if w not in known]
    if len(known) + 2 * len(new) > WORDS_KEPT:
        known.clear()
        new = list(seen)
    short = [w for w in new if len(w) <= WORD_BYTES]
    _learn(short, encoder, known)
    if len(short) < len(new):
        once: dict[bytes, bytes] = {}
        _learn([w for w in new if len(w) > WORD_BYTES], encoder, once)
        return [b"".join([once[w] if w in once else known[w] for w in ws]) for ws in split]
    return [b"".join(map(known.__getitem__, ws)) for ws in split]


def tokenized(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece of each of docs(doc_id, text): uid (unique), doc_id, piece, start, length, ids_crc32."""

    def cut(batches):
        context = TaskContext.get()
        uid = (context.partitionId() if context else 0) << 36
        close = np.array([END], "<u4").tobytes()
        for batch in common.slices(batches):
            data, offsets = tx.utf8(batch.column("text"))
            raw = data.tobytes()
            texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            rows, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(_encode_all(texts, tokenizer)):
                ids += close
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(uid, uid + n)),
                    batch.column("doc_id").take(pa.array(rows)),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                ["uid", "doc_id", "piece", "start", "length", "ids_crc32"],
            )
            uid += n

    return common.mapped(docs, cut, _PIECES, keeps="op10")


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The best dual-feasible-function bound on the number of bins for these lengths."""
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((counts * x).sum()) // capacity)
    # u_e: above capacity - e a bin of their own, below e nothing
    mass, above = np.cumsum(counts * x), np.cumsum(counts[::-1])[::-1]
    for e in range(1, capacity // 2 + 1):
        middle = int(mass[capacity - e] - mass[e - 1])
        large = int(above[capacity - e + 1])
        best = max(best, large - (-middle // capacity))
    # f_k: rounding down to multiples of 1 / k of (k + 1) x
    for k in range(1, 33):
        scaled = (k + 1) * x
        whole = scaled % capacity == 0
        value = np.where(whole, x * k, (scaled // capacity) * capacity)  # times k * capacity
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset of each length; free space of each bin): best-fit decreasing."""
    n = len(lengths)
    where, offset = np.empty(n, np.int64), np.empty(n, np.int64)
    space: list[int] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0  # bit s is set if a bin has s free places
    for i in np.argsort(-lengths, kind="stable").tolist():
        x = int(lengths[i])
        fits = open_ >> x
        if fits:
            s = x + (fits & -fits).bit_length() - 1
            b = free[s].pop()
            if not free[s]:
                open_ ^= 1 << s
        else:
            s, b = capacity, len(space)
            space.append(capacity)
        where[i], offset[i] = b, capacity - s
        rest = s - x
        space[b] = rest
        if rest:
            if not free[rest]:
                open_ |= 1 << rest
            free[rest].append(b)
    return where, offset, np.array(space, np.int64)


_PLACED = "uid long, length long, part long, sequence_id long, offset long, final boolean, bins long, bound long"


def _round(loose: DataFrame, number: int, last: bool, capacity: int, exchanged: int) -> DataFrame:
    """Packs each part of loose(uid, length, part); bins and bound are those of the part."""

    def place(part, table):
        table = table.sort_by("uid")
        lengths = table.column("length").to_numpy()
        where, offset, space = best_fit(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        final = np.ones(len(space), bool)
        if len(space) > bound and not last:
            loosest = np.argsort(-space, kind="stable")[: exchanged * (len(space) - bound)]
            final[loosest[space[loosest] > 0]] = False
        n = len(lengths)
        one = lambda v: pa.array(np.full(n, v, np.int64))
        base = (number << 56) | (int(part[0].as_py()) << 28)
        return pa.table(
            [table.column("uid"), table.column("length"), one(part[0].as_py()), pa.array(base + where), pa.array(offset), pa.array(final[where]), one(len(space)), one(bound)],
            ["uid", "length", "part", "sequence_id", "offset", "final", "bins", "bound"],
        )

    return loose.groupBy("part").applyInArrow(place, _PLACED)


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_partition: int = 20_000, fan: int = 8, exchanged: int = 64) -> DataFrame:
    """(uid, sequence_id, offset) for pieces(uid, length), each at most capacity long."""
    whole = pieces.where(F.col("length") == capacity).select("uid", (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    loose = pieces.where(F.col("length") < capacity).select("uid", "length")
    parts = -(-loose.count() // per_partition)
    out, number, last = whole, 0, parts == 1
    loose = loose.withColumn("part", F.pmod(F.xxhash64("uid"), F.lit(max(1, parts))))
    while parts:
        placed = common.written(_round(loose, number, last, capacity, exchanged))
        out = out.union(placed.where("final").select("uid", "sequence_id", "offset"))
        loose = placed.where("not final")
        n = 0 if last else loose.count()
        fewer = -(-parts // fan)
        wanted = max(fewer, -(-n // per_partition)) if n else 0
        meet = F.floor(F.col("part") / fan) if wanted == fewer else F.pmod(F.xxhash64("sequence_id"), F.lit(max(1, wanted)))
        loose = loose.select("uid", "length", meet.alias("part"))
        last = wanted == 1 or 2 * wanted > parts
        parts, number = wanted, number + 1
    return out


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, **settings) -> DataFrame:
    """Every piece of docs(doc_id, text) with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    docs = common.named(docs, doc_id="doc_id", text="text")
    pieces = common.written(tokenized(docs, tokenizer, capacity))
    return pieces.join(pack(pieces, capacity, **settings), "uid").select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary())
