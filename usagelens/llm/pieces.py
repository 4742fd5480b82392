"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding."""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Share of candidate merges that are skipped.
DROPOUT, SEED = 0.1, 17
SPACE = "▁"
#: Longer chunks are encoded one by one.
LONG = 64
#: Chunks of like length are worked on together.
_WIDTHS = (2, 4, 5, 6, 7, 8, 9, 10, 12, 14, 17, 20, 26, 36, 64)
#: Bytes of paths that a worker keeps, and what one takes beside its text and codes.
_CACHE_BYTES, _ENTRY = 40 << 20, 350
#: Things met once that a worker remembers.
_ONCE = 200_000
_CHARS, _NONE = 1 << 20, np.iinfo(np.int32).min
_CHUNKS = re.compile(f"[{SPACE}\n]| +[^ {SPACE}\n]*|[^ {SPACE}\n]+")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Pieces:
    """Merge table and piece names of a SentencePiece BPE model with byte pieces."""

    def __init__(self, model: bytes) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.names = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        usable = {
            name: i
            for i, name in enumerate(self.names)
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))
        }
        self.bytes = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        byte_of = {int(p): b for b, p in enumerate(self.bytes)}
        self.as_bytes = [
            bytes([byte_of[i]]) if i in byte_of else name.replace(SPACE, " ").encode()
            for i, name in enumerate(self.names)
        ]
        self.lengths = np.array([len(b) for b in self.as_bytes], np.int64)
        # Piece of each code point; a space is shown by its mark.
        self.of_point = np.full(0x110000, -1, np.int32)
        for name, i in usable.items():
            if len(name) == 1:
                self.of_point[ord(name)] = i
        self.of_point[ord(" ")] = self.of_point[ord(SPACE)]
        left, right, merged = [], [], []
        for name, i in usable.items():
            for k in range(1, len(name)):
                a, b = usable.get(name[:k]), usable.get(name[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(i)
        code = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        order = np.argsort(code)
        self.code, self.merged = code[order], np.array(merged, np.int32)[order]
        self.merge = dict(zip(zip(left, right), merged))
        # One pair by slot of its hash; those that share a slot with it are found by search.
        self.shift = np.uint64(64 - max(16 * len(self.code), 2).bit_length())
        self.slots = np.full(1 << (64 - int(self.shift)), -1, np.int32)
        self.slots[self._slot(self.code)] = np.arange(len(self.code))
        # Merges are ranked by score, best first; equal scores share a rank.
        scores = np.array([sp.get_score(i) for i in range(len(self.names))])
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)

    def starts(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of the single characters of all chunks in a row, and each chunk's length.

        What has no piece, and a chunk that is a space mark of the text itself, is -1 - its code point.
        """
        points = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.int32)
        sizes = np.array([len(c) for c in chunks], np.int64)
        ids = self.of_point[points]
        literal = (points == ord(SPACE)) & np.repeat(sizes == 1, sizes)
        return np.where((ids < 0) | literal, -1 - points, ids), sizes

    def candidates(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two neighbours merge to, or -1."""
        # A code with a character that has no piece is negative and equals none.
        code = left.astype(np.int64) << 32 | right
        at = self.slots[self._slot(code)]
        hit = self.code[at] == code
        out = np.where(hit, self.merged[at], np.int32(-1))
        shared = np.nonzero(~hit & (at >= 0))
        if len(shared[0]):
            rest = code[shared]
            at = np.minimum(np.searchsorted(self.code, rest), len(self.code) - 1)
            out[shared] = np.where(self.code[at] == rest, self.merged[at], np.int32(-1))
        return out

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return (code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift


def split(text: str) -> list[str]:
    """Chunks that no merge crosses: a run of spaces with the word after it, and line feeds, which have no piece.

    A space mark that is in the text itself is put apart and will be written as bytes.
    """
    return _CHUNKS.findall(" " + text)


def encode_long(ids: list, key: int, pieces: Pieces, limit: int) -> np.ndarray:
    """One long chunk by a heap of candidates; the same choices as `encode_chunks`, in n log n steps."""
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    merge = pieces.merge
    heap: list[tuple[int, int, int, int, int]] = []

    def push(i: int) -> None:
        j = after[i]
        if j < n and (m := merge.get((ids[i], ids[j]))) is not None:
            heapq.heappush(heap, (int(pieces.rank[m]), i, ids[i], ids[j], m))

    for i in range(n - 1):
        push(i)
    while heap:
        _, i, a, b, m = heapq.heappop(heap)
        j = after[i] if ids[i] is not None else n
        if ids[i] != a or j >= n or ids[j] != b:
            continue
        if limit and int(_mixed(np.array([key ^ (a << 40) ^ (b << 20) ^ i], np.uint64))[0]) < limit:
            continue
        ids[i], ids[j] = m, None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    return np.array([i for i in ids if i is not None], np.int32)


def encode_chunks(chunks: list[str], draws: list[int], pieces: Pieces, dropout: float, seed: int) -> list[bytes]:
    """Piece ids (as bytes of int32) of chunks, all chunks in step: each round takes every chunk's best candidate.

    The best candidate of a chunk's agenda has the highest score, the leftmost first. It is merged unless the hash of
    seed, draw, chunk and candidate (its two pieces and its place) falls below the dropout; a skipped candidate stays
    out of the agenda until one of its pieces changes. Without dropout this is SentencePiece's own segmentation.
    """
    keys = np.array(
        [
            xxhash.xxh64_intdigest(chunk.encode("utf-8", "surrogatepass"), seed * 1_000_003 + draw)
            for chunk, draw in zip(chunks, draws)
        ],
        np.uint64,
    )
    return encode_keyed(chunks, keys, pieces, _limit(dropout))


def _limit(dropout: float) -> int:
    """Candidates whose hash is below are skipped."""
    return min(int(dropout * 2.0**64), 2**64 - 1)


def encode_keyed(chunks: list[str], keys: np.ndarray, pieces: Pieces, limit: int) -> list[bytes]:
    """`encode_chunks` with a key per chunk in the place of seed, draw and chunk."""

    def skips(_step: int, part: np.ndarray, code: np.ndarray) -> np.ndarray:
        return _mixed(keys[part] ^ code) < np.uint64(limit)

    return _encoded(chunks, keys, pieces, limit, skips)[0]


def encode_forced(chunks: list[str], masks: np.ndarray, pieces: Pieces) -> tuple[list[bytes], list[np.ndarray]]:
    """Piece ids of chunks of up to LONG characters when exactly the candidates at the steps set in a chunk's mask are
    skipped, and the codes of its candidates step by step, a code being what is hashed with the key.
    """

    def skips(step: int, part: np.ndarray, _code: np.ndarray) -> np.ndarray:
        return (masks[part] >> np.uint64(min(step, 63))) & np.uint64(step < 63) == 1

    out, steps = _encoded(chunks, masks, pieces, 0, skips)
    owner = np.concatenate([np.empty(0, np.int64), *(p for p, _ in steps)])
    codes = np.concatenate([np.empty(0, np.uint64), *(c for _, c in steps)])
    ends = np.cumsum(np.bincount(owner, minlength=len(chunks)))
    return out, np.split(codes[np.argsort(owner, kind="stable")], ends[:-1]) if chunks else []


def _encoded(chunks, keys, pieces, limit, skips) -> tuple[list[bytes], list[tuple[np.ndarray, np.ndarray]]]:
    """Piece ids of all chunks, and (chunks, codes of their candidates) of every round."""
    out: list[bytes] = [b""] * len(chunks)
    flat, sizes = pieces.starts(chunks)
    begin = np.cumsum(sizes) - sizes
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for k in np.flatnonzero(sizes > LONG):
        ids = encode_long(flat[begin[k] : begin[k] + sizes[k]].tolist(), int(keys[k]), pieces, limit)
        _put(out, np.array([k]), ids, np.array([len(ids)]), pieces)
    for low, width in zip((-1, *_WIDTHS), _WIDTHS):
        all_of = np.flatnonzero((sizes > low) & (sizes <= min(width, LONG)))
        step = max(1, (1 << 16) // width)
        for first in range(0, len(all_of), step):
            part = all_of[first : first + step]
            _merge_rounds(out, part, flat, begin, sizes, width, pieces, skips, steps)
    return out, steps


def _put(out: list[bytes], part: np.ndarray, flat: np.ndarray, counts: np.ndarray, pieces: Pieces) -> None:
    """Writes the rows of `flat`; characters without a piece become the pieces of their UTF-8 bytes."""
    odd = np.zeros(len(part), bool)
    if (flat < 0).any():
        odd[np.repeat(np.arange(len(part)), counts)[flat < 0]] = True
    data, ends = flat.astype(np.int32, copy=False).tobytes(), (4 * np.cumsum(counts)).tolist()
    low = 0
    for k, high in zip(part.tolist(), ends):
        out[k] = data[low:high]
        low = high
    starts = np.cumsum(counts) - counts
    for r in np.flatnonzero(odd):
        ids: list[int] = []
        for i in flat[starts[r] : starts[r] + counts[r]].tolist():
            ids += [i] if i >= 0 else pieces.bytes[list(chr(-1 - i).encode("utf-8", "surrogatepass"))].tolist()
        out[int(part[r])] = np.array(ids, np.int32).tobytes()


def _merge_rounds(out, part, flat, begin, sizes, width, pieces, skips, steps) -> None:
    """Segments chunks of up to `width` characters, one candidate per chunk and round; `steps` lists the rounds.

    A piece stays at the place of its first character; `after` and `before` lead to its neighbours' places.
    """
    column = np.arange(width + 1)
    there = column < sizes[part][:, None]
    ids = np.full(there.shape, _NONE, np.int32)
    ids[there] = flat[(begin[part][:, None] + column)[there]]
    after, before = (np.broadcast_to((column + k).astype(np.int16), ids.shape).copy() for k in (1, -1))
    worst = np.int32(len(pieces.names))
    made = pieces.candidates(ids[:, :-1], ids[:, 1:])
    rank = np.where(made >= 0, pieces.rank[made], worst)
    step = -1
    while len(part):
        step += 1
        best = rank.argmin(axis=1)
        found = rank[np.arange(len(part)), best] < worst
        if 3 * np.count_nonzero(found) < 2 * len(part):
            ready = ids[~found]
            real = ready != _NONE
            _put(out, part[~found], ready[real], real.sum(axis=1), pieces)
            ids, made, rank, after, before = (x[found] for x in (ids, made, rank, after, before))
            part, best = part[found], best[found]
            found = np.ones(len(part), bool)
            if not len(part):
                return
        row = np.flatnonzero(found)
        at = best[row]
        right = after[row, at]
        pair = (ids[row, at].astype(np.uint64) << np.uint64(40)) ^ (ids[row, right].astype(np.uint64) << np.uint64(20))
        code = pair ^ at.astype(np.uint64)
        steps.append((part[row], code))
        skip = skips(step, part[row], code)
        rank[row[skip], at[skip]] = worst
        row, at, right = row[~skip], at[~skip], right[~skip]
        piece, then = made[row, at], after[row, right]
        ids[row, at], ids[row, right], rank[row, right] = piece, _NONE, worst
        after[row, at], before[row, then] = then, at
        _renew(row, at, pieces.candidates(piece, ids[row, then]), made, rank, pieces, worst)
        left = before[row, at]
        inner = left >= 0
        row, left = row[inner], left[inner]
        _renew(row, left, pieces.candidates(ids[row, left], piece[inner]), made, rank, pieces, worst)


def _renew(row, at, merged, made, rank, pieces, worst) -> None:
    made[row, at] = merged
    rank[row, at] = np.where(merged >= 0, pieces.rank[merged], worst)


def _decode_to(found: list[bytes], chunks: list[str], pieces: Pieces) -> np.ndarray:
    """Whether the ids of each chunk decode to it: all in a row if they do, else one by one."""
    ids = np.frombuffer(b"".join(found), np.int32)
    data = [c.encode("utf-8", "surrogatepass") for c in chunks]
    ends = np.cumsum([len(f) // 4 for f in found], dtype=np.int64)
    lengths = np.diff(np.r_[0, np.cumsum(pieces.lengths[ids])][np.r_[0, ends]])
    names = pieces.as_bytes
    if b"".join(map(names.__getitem__, ids.tolist())) == b"".join(data) and (lengths == [len(d) for d in data]).all():
        return np.ones(len(chunks), bool)
    each = (b"".join(map(names.__getitem__, np.frombuffer(f, np.int32).tolist())) == d for f, d in zip(found, data))
    return np.fromiter(each, bool, len(chunks))


def decode_ids(ids: np.ndarray, pieces: Pieces) -> str:
    """The text again: the space that encoding puts in front goes."""
    data = b"".join(map(pieces.as_bytes.__getitem__, ids.tolist()))
    return data[1:].decode("utf-8", "surrogatepass")


class Encoder:
    """Encodes texts; keeps what chunks met lately give for the skips met lately, up to a bound in bytes.

    A path is a chunk with a set of steps at which the candidate is skipped. An occurrence starts on its chunk's path
    without skips, draws for each candidate in turn, and at its first skip goes over to the path with that skip too.
    Only paths that no occurrence has taken before are worked out.
    """

    def __init__(self, model: bytes, dropout: float, seed: int) -> None:
        self.pieces, self.limit, self.seed = Pieces(model), _limit(dropout), seed
        self._clear()

    def _clear(self) -> None:
        """Paths' numbers by chunk and by (path, step); their chunks, pieces, skips; the codes that are still to draw."""
        self.known: dict[str, int] = {}
        self.child: dict[int, int] = {}
        self.chunk: list[str] = []
        self.plain: list[bytes] = []
        self.masks = np.empty(0, np.uint64)
        self.codes, self.begin, self.count, self.start = np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3))
        self.whole = np.empty(0, bool)
        self.size, self.once = 0, set()

    def _learn(self, chunks: list[str], masks: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Numbers of new paths, whose candidates from step `start` on are still to draw."""
        first = len(self.chunk)
        short = np.array([len(c) <= LONG for c in chunks], bool)
        found, steps = encode_forced([c for c, s in zip(chunks, short) if s], masks[short], self.pieces)
        plain, codes = iter(found), iter(steps)
        none = np.empty(0, np.uint64)
        # A long chunk has no path: each occurrence is encoded with its own key.
        paths = [next(codes)[k:] if s else none for s, k in zip(short, start.tolist())]
        self.plain += [next(plain) if s else b"" for s in short]
        self.chunk += chunks
        fine = _decode_to(self.plain[first:], chunks, self.pieces)
        count = np.array([len(p) for p in paths], np.int64)
        self.begin = np.r_[self.begin, len(self.codes) + np.cumsum(count) - count]
        self.count = np.r_[self.count, np.where(short, count, -1)]
        self.codes = np.concatenate([self.codes, *paths])
        self.start, self.masks = np.r_[self.start, start], np.r_[self.masks, masks]
        self.whole = np.r_[self.whole, fine]
        self.size += sum(_ENTRY + 2 * len(c) + 8 * len(p) for c, p in zip(chunks, paths))
        return np.arange(first, len(self.chunk))

    def _again(self, what: int, often: int) -> bool:
        """Whether a chunk or path that isn't known has come up before: one that comes up once is not worth keeping."""
        if often > 1 or what in self.once:
            return True
        if len(self.once) > _ONCE:
            self.once.clear()
        self.once.add(what)
        return False

    def _first_skips(self, path: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The step of each occurrence's first skip on its path, or -1."""
        out = np.full(len(path), -1, np.int64)
        left, k = np.flatnonzero(self.count[path] > 0), 0
        while len(left):
            on = path[left]
            skip = _mixed(keys[left] ^ self.codes[self.begin[on] + k]) < np.uint64(self.limit)
            out[left[skip]] = self.start[on[skip]] + k
            k += 1
            left = left[~skip & (self.count[on] > k)]
        return out

    def _paths(self, flat: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each occurrence's path, and those to encode by themselves: of rare and long chunks, with rare or late skips."""
        place: dict[str, int] = defaultdict()
        place.default_factory = place.__len__
        which = np.fromiter(map(place.__getitem__, flat), np.int64, len(flat))
        distinct, often = list(place), np.bincount(which, minlength=len(place)).tolist()
        at = np.array([self.known.get(c, -1) for c in distinct], np.int64)
        missing = [k for k in np.flatnonzero(at < 0).tolist() if self._again(hash(distinct[k]), often[k])]
        if missing:
            new = [distinct[k] for k in missing]
            at[missing] = self._learn(new, np.zeros(len(new), np.uint64), np.zeros(len(new), np.int64))
            self.known.update(zip(new, at[missing].tolist()))
        path = at[which]
        live = np.flatnonzero(path >= 0)
        alone = [np.flatnonzero(path < 0), live[self.count[path[live]] < 0]]
        while len(live):
            step = self._first_skips(path[live], keys[live])
            alone.append(live[step >= 63])
            there = (step >= 0) & (step < 63)
            live, step = live[there], step[there]
            asked, back, often = np.unique(path[live] << 6 | step, return_inverse=True, return_counts=True)
            at = np.array([self.child.get(a, -1) for a in asked.tolist()], np.int64)
            missing = np.array([k for k in np.flatnonzero(at < 0).tolist() if self._again(int(asked[k]), often[k])], np.int64)
            if len(missing):
                above, skipped = asked[missing] >> 6, asked[missing] & 63
                masks = self.masks[above] | np.uint64(1) << skipped.astype(np.uint64)
                at[missing] = self._learn([self.chunk[k] for k in above.tolist()], masks, skipped + 1)
                self.child.update(zip(asked[missing].tolist(), at[missing].tolist()))
            path[live] = at[back]
            alone.append(live[path[live] < 0])
            live = live[path[live] >= 0]
        return path, np.concatenate(alone)

    def __call__(self, texts: list[str], marks: list[int]) -> tuple[list[bytes], list[bool]]:
        """Piece ids of each text, as bytes of int32, and whether they decode to it.

        A chunk's key is made of the text's mark and its place there. A text decodes to itself if its chunks make it up
        and each chunk's pieces decode to the chunk.
        """
        if self.size > _CACHE_BYTES:
            self._clear()
        chunks = [split(t) if t else [] for t in texts]
        flat = [c for parts in chunks for c in parts]
        sizes = np.array([len(parts) for parts in chunks], np.int64)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        start = _mixed(np.array([m & (2**64 - 1) for m in marks], np.uint64) + np.uint64(self.seed))
        keys = _mixed(np.repeat(start, sizes) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        path, alone = self._paths(flat, keys)
        path[alone] = 0
        if not self.chunk:
            found, whole = [b""] * len(flat), np.zeros(len(flat), bool)
        else:
            found, whole = list(map(self.plain.__getitem__, path.tolist())), self.whole[path]
        asked = [flat[k] for k in alone.tolist()]
        own = encode_keyed(asked, keys[alone], self.pieces, self.limit)
        whole[alone] = _decode_to(own, asked, self.pieces)
        for k, ids in zip(alone.tolist(), own):
            found[k] = ids
        ends = np.cumsum(sizes)
        broken = np.r_[0, np.cumsum(~whole)]
        fine = (broken[ends] == broken[ends - sizes]).tolist()
        out = [b"".join(found[high - len(parts) : high]) for parts, high in zip(chunks, ends.tolist())]
        return out, [f and "".join(parts) == (" " + t if t else "") for f, parts, t in zip(fine, chunks, texts)]


def _encode_batches(batches: Iterator[pa.RecordBatch], model: bytes, dropout: float, seed: int):
    encoder = Encoder(model, dropout, seed)
    for batch in batches:
        ids, texts, marks = batch.column(0), batch.column(1), batch.column(2)
        lengths = pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
        for low, high in slices(lengths, _CHARS):
            part = [texts[k].as_py() or "" for k in range(low, high)]
            found, same = encoder(part, marks.slice(low, high - low).to_pylist())
            offsets = np.cumsum([0, *(len(f) // 4 for f in found)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(low, high - low),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), np.int32))),
                    pa.array(same),
                ],
                names=["id", "ids", "lossless"],
            )


def decoded(ids: Column, model: bytes) -> Column:
    """The text of a column of ids; null and empty give an empty text."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = Pieces(model)
        for batch in batches:
            yield pd.Series([decode_ids(i, pieces) if i is not None and len(i) else "" for i in batch], dtype=object)

    return run(ids)


def encode(
    docs: DataFrame,
    model_path: str = MODEL,
    id_col: str = "doc_id",
    text_col: str = "text",
    dropout: float = DROPOUT,
    seed: int = SEED,
) -> DataFrame:
    """The id, `ids`, `n_tokens` and `lossless` of every row; only these columns come out.

    Which merges are skipped follows from a hash of id, seed and the chunk's place in the text, so every occurrence of
    a word is drawn for itself, inside a document too, and every run gives the same ids; `lossless` says that decoding gave the text again. Each row is encoded where it
    lies, without a shuffle. Repeated rows get the same ids. A null id draws like the id
    0. A null text counts as empty. A surrogate or space mark in a text is written as bytes. An empty table gives no
    rows. The model file is read by the driver and sent to the tasks (its size is fixed).
    """
    with open(model_path, "rb") as f:
        model = f.read()
    plain = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    mark = F.xxhash64(F.lit(seed), F.coalesce(F.col("id"), F.lit(0)).cast("long"))
    rows = plain.select("id", "text", mark.alias("mark"))
    out = rows.mapInArrow(
        lambda b: _encode_batches(b, model, dropout, seed),
        f"id {plain.schema['id'].dataType.simpleString()}, ids array<int>, lossless boolean",
    )
    return out.select(F.col("id").alias(id_col), "ids", F.size("ids").alias("n_tokens"), "lossless")
