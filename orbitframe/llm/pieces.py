"""Encoding and decoding with a merge-type piece model (SentencePiece BPE with byte fallback), without running merges over the text.

Every prefix of a text has one encoding, so one last token. A table holds it per prefix: of the tokens that an
automaton finds to end there, it is the one that may follow the last token of the prefix it leaves. Ids are then
read off backwards. The work is linear in the text, however long a run without spaces is.

Whether two tokens may stand side by side is tested from their merge histories (``Pieces.compatible``): a pair is
broken if, while both are built, some merge across the border would come first. A sequence is the model's encoding
exactly if each token encodes to itself and each pair of neighbours is compatible. Pairs are remembered.

No piece of such a model holds a space after another character, so a text is cut into units (spaces with what
follows them), and each distinct unit of a slice is encoded once; units are compared as bytes.

Defined cases: null text is empty, so only the end id; empty text has no leading space; characters without a piece
become byte ids; a literal U+2581 counts as a space, as in the library; repeated and null doc_ids are separate rows;
texts of one run without spaces, of any length, take time and memory in proportion; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import codecs
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitframe.llm import textarrow as ta

MODEL, SPACE, NEVER = "piece_bpe_32k.model", "▁", 1 << 60
MARK = np.frombuffer(SPACE.encode(), np.uint8)
KNOWN_UNITS, KNOWN_PAIRS, UNIT_BYTES, CHUNK_BYTES = 200_000, 2_000_000, 64, 1 << 18

# One replacement character for each byte that is no part of a character, as the library has it.
codecs.register_error("orbitframe_each", lambda e: ("�", e.start + 1))


def merges(chars: str, rank: dict[str, int]) -> tuple[list[str], list[tuple[int, int, int]]]:
    """Greedy merging: (tokens left, merges done as (rank, begin, end)). The best rank goes first, then the leftmost."""
    parts, at, done = list(chars), list(range(len(chars) + 1)), []
    while len(parts) > 1:
        best, k = min((rank.get(a + b, NEVER), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if best == NEVER:
            break
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
        del at[k + 1]
        done.append((best, at[k], at[k + 1]))
    return parts, done


def border(done: list[tuple[int, int, int]], chars: str, right: bool) -> list[tuple[str, int, int, int]]:
    """The parts that stand at one end of a token while it is built: (part, born, gone, life).

    Times are the worst rank so far, since a better merge that a worse one makes possible follows it at once;
    ``life`` is the worst rank among the merges from its birth to the one that ends it.
    """
    n, born, since, out = len(chars), -1, -1, []
    part, so_far = (chars[-1] if right else chars[0]), -1
    for r, a, b in done:
        so_far, since = max(so_far, r), max(since, r)
        if (b == n) if right else (a == 0):
            out.append((part, born, so_far, since))
            part, born, since = chars[a:b], so_far, -1
    out.append((part, born, NEVER, NEVER))
    return out


class Pieces:
    """A model's vocabulary as automaton, merge histories and surfaces."""

    def __init__(self, model: str = MODEL):
        import ahocorasick
        import public_tokenizers
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=public_tokenizers.path(model))
        if sp.normalize(" éﬁ  A") != f"{SPACE}{SPACE}éﬁ{SPACE}{SPACE}A":
            raise ValueError("the model must keep texts as they are, but for one space before them")
        size = sp.vocab_size()
        self.end_id, self.unknown = sp.eos_id(), sp.unk_id()
        self.byte_id = np.zeros(256, np.int32)
        self.control, self.byte = np.zeros(size, bool), np.zeros(size, bool)
        self.leads = np.zeros(size, bool)
        surface, plain = [], {}
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value], self.byte[i] = i, True
                surface.append(bytes([value]))
            elif sp.is_control(i):
                self.control[i] = True
                surface.append(b"")
            elif sp.is_unknown(i):
                surface.append(" ⁇ ".encode())
            else:
                plain[piece] = i
                self.leads[i] = piece.startswith(SPACE)
                surface.append(piece.replace(SPACE, " ").encode())
        if any(SPACE in p.lstrip(SPACE) for p in plain):
            raise ValueError("a piece holds a space after another character")
        lengths = np.array([len(s) for s in surface], np.int64)
        self.surface, self.surface_at, self.surface_len = np.frombuffer(b"".join(surface), np.uint8), np.cumsum(lengths) - lengths, lengths
        scores = {p: sp.get_score(i) for p, i in plain.items()}
        order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {p: order[s] for p, s in scores.items() if len(p) > 1}
        # Characters that only stand inside pieces are tokens too, numbered after the pieces and written as bytes.
        spare = sorted({c for p in plain for c in p} - plain.keys())
        self.tokens = plain | {c: size + k for k, c in enumerate(spare)}
        # The automaton holds a record a token: (id to write or -1, length, what may follow as far as known, token).
        self.automaton = ahocorasick.Automaton()
        self.records, self.left, self.right, self.n_pairs = [], {}, {}, 0
        for piece, i in self.tokens.items():
            parts, done = merges(piece, self.rank)
            if len(parts) == 1:  # a piece that its own merges never make occurs in no encoding
                self.records.append((i if i < size else -1, len(piece), {}, i))
                self.automaton.add_word(piece, self.records[-1])
                self.left[i], self.right[i] = border(done, piece, False), border(done, piece, True)
        self.automaton.make_automaton()
        alphabet = {c for p in self.tokens for c in p}
        self.apart = next(c for c in map(chr, range(1, 1 << 16)) if c not in alphabet)
        self.known: dict[bytes, bytes] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether token b may follow token a: no merge across the border would come before those that build them."""
        for x, x_born, x_gone, x_life in self.right[a]:
            for y, y_born, y_gone, y_life in self.left[b]:
                cross = self.rank.get(x + y)
                if cross is None:
                    continue
                # Of equal ranks the leftmost merge is first: those in a, then the one across, then those in b.
                if y_born >= x_born:
                    if x_gone > y_born and cross < x_gone and cross <= y_life:
                        return False
                elif y_gone >= x_born and cross < x_life and cross <= y_gone:
                    return False
        return True

    def prefix_table(self, text: str) -> list[tuple | None]:
        """The record of the last token of each prefix; None for a character without a token, like the text's first one."""
        last: list[tuple | None] = [None] * len(text)
        if self.n_pairs > KNOWN_PAIRS:
            self.n_pairs = 0
            for record in self.records:
                record[2].clear()
        for end, record in self.automaton.iter(text):
            if last[end] is None:
                before = last[end - record[1]]
                if before is not None:
                    fits = before[2].get(record[3])
                    if fits is None:
                        fits = before[2][record[3]] = self.compatible(before[3], record[3])
                        self.n_pairs += 1
                    if not fits:
                        continue
                last[end] = record
        return last

    def backwards(self, text: str, last: list[tuple | None], begin: int, end: int) -> bytes:
        """The ids of text[begin:end] as 32-bit integers."""
        ids, i = [], end - 1
        while i >= begin:
            record = last[i]
            if record is not None and record[0] >= 0:
                ids.append(record[0])
                i -= record[1]
            else:
                ids.extend(int(self.byte_id[b]) for b in reversed(text[i].encode()))
                i -= 1
        return array("i", ids[::-1]).tobytes()

    def units(self, units: list[bytes]) -> list[bytes]:
        """Ids of each unit. Units go through the automaton in chunks, kept apart by a character that no piece has."""
        if len(self.known) > KNOWN_UNITS:
            self.known.clear()
        out = list(map(self.known.get, units))
        chunk, size = [], 0
        todo = [k for k, ids in enumerate(out) if ids is None]
        for k in todo:
            chunk.append(k)
            size += len(units[k])
            if size >= CHUNK_BYTES or k == todo[-1]:
                parts = [units[c].decode() for c in chunk]
                text, at = self.apart + self.apart.join(parts), 1
                last = self.prefix_table(text)
                for c, part in zip(chunk, parts, strict=True):
                    out[c] = self.backwards(text, last, at, at + len(part))
                    at += len(part) + 1
                chunk, size = [], 0
        self.known.update((units[k], out[k]) for k in todo if len(units[k]) <= UNIT_BYTES)
        return out

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, where each row's begin), for rows of bytes whose spaces are marks, the first one included."""
        n, rows = len(data), len(off) - 1
        if n == 0:
            return np.zeros(0, np.int32), np.zeros(rows + 1, np.int64)
        mark = np.zeros(n + 3, bool)
        mark[: n - 2] = (data[:-2] == MARK[0]) & (data[1:-1] == MARK[1]) & (data[2:] == MARK[2]) if n > 2 else False
        begins = mark[:n].copy()
        begins[3:] &= ~mark[: n - 3]
        begins[off[:-1][off[:-1] < n]] = True
        starts = np.flatnonzero(begins)
        bounds = np.append(starts, n).astype(np.int64)
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        pool = self.units(found.dictionary.to_pylist())
        counts = np.fromiter(map(len, pool), np.int64, len(pool)) // 4
        where, which = np.cumsum(counts) - counts, found.indices.to_numpy()
        per = counts[which]
        ids = np.frombuffer(b"".join(pool), np.int32)[np.repeat(where[which], per) + ta.ranges(per)]
        return ids, np.append(0, np.cumsum(per))[np.searchsorted(starts, off)]

    def decode(self, ids: np.ndarray, off: np.ndarray) -> list[bytes]:
        """UTF-8 of each row of ids. The one space before a text goes; bytes that form no character become U+FFFD each."""
        lengths = self.surface_len[ids]
        data = self.surface[np.repeat(self.surface_at[ids], lengths) + ta.ranges(lengths)]
        at = np.append(0, np.cumsum(lengths))[off]
        shown = np.append(np.flatnonzero(~self.control[ids]), len(ids))
        first = shown[np.searchsorted(shown, off[:-1])]
        has = first < off[1:]
        begin = at[:-1] + (has & self.leads[ids[np.minimum(first, max(len(ids) - 1, 0))]] if len(ids) else 0)
        raw = data.tobytes()
        texts = [raw[a:b] for a, b in zip(begin.tolist(), at[1:].tolist(), strict=True)]
        try:
            raw.decode()
        except UnicodeDecodeError:
            texts = [t.decode("utf-8", "orbitframe_each").encode() for t in texts]
        # A control id between two byte ids parts them, so what they hold is read one by one.
        parting = np.flatnonzero(self.control[ids[1:]] & self.byte[ids[:-1]]) + 1
        for row in np.unique(np.searchsorted(off, parting, "right") - 1):
            cuts = [off[row], *(k for k in parting if off[row] < k < off[row + 1]), off[row + 1]]
            ends = np.append(0, np.cumsum(lengths))
            spans = [raw[max(ends[a], begin[row]) : ends[b]] for a, b in zip(cuts, cuts[1:], strict=False)]
            texts[row] = b"".join(x.decode("utf-8", "orbitframe_each").encode() for x in spans)
        return texts


@cache
def pieces_of(model: str) -> Pieces:
    """One table a worker process, kept between its tasks."""
    return Pieces(model)


def marked(texts: pa.Array) -> pa.Array:
    """Texts as the model sees them: a mark for each space and one before every text that isn't empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    shown = pc.replace_substring(texts, " ", SPACE)
    return pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(pa.scalar(SPACE, pa.large_string()), shown, pa.scalar("", pa.large_string())))


def encoder(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        for batch in batches:
            _, sizes = ta.utf8(batch.column(1))
            for lo, hi in ta.slices(sizes):
                data, off = ta.utf8(marked(batch.column(1).slice(lo, hi - lo)))
                ids, at = pieces.encode(data, off)
                n = np.diff(at) + 1
                flat = np.full(len(ids) + hi - lo, pieces.end_id, np.int32)
                flat[np.arange(len(ids)) + np.repeat(np.arange(hi - lo), n - 1)] = ids
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], ["doc_id", "ids"])

    return run


def decoder(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        for batch in batches:
            lists = batch.column(1)
            off = lists.offsets.to_numpy().astype(np.int64)
            for lo, hi in ta.slices(off, ta.SLICE_BYTES // 4):
                ids = lists.values.slice(off[lo], off[hi] - off[lo]).to_numpy()
                texts = pieces.decode(ids, off[lo : hi + 1] - off[lo])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists.slice(lo, hi - lo), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "ids", "text"])

    return run


def encode_documents(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, ids): the ids of each whole text, closed by the end id."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encoder(model), "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, ids, text): what the ids say. A null list of ids counts as empty."""
    ids = F.coalesce(F.col("ids").cast("array<int>"), F.array().cast("array<int>"))
    return encoded.select("doc_id", ids.alias("ids")).mapInArrow(decoder(model), "doc_id long, ids array<int>, text string")


def digests(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """One row a document: how many ids, a digest of them, and a digest of the text they decode to."""
    both = decode_documents(encode_documents(docs, model), model)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
