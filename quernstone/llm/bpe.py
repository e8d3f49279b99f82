"""BPE encoding and decoding with reuse of content-defined chunks.

Texts are cut before white space into pieces; where a rolling hash of the last 16 bytes before a cut says so
(about every 32nd), a chunk begins, so a passage is chunked alike in every document that has it.
A chunk's ids are made once and kept in a table of bounded memory that lives as long as the worker
process, across documents and tasks; every later occurrence takes them from there.  A chunk that isn't known is
put together from pieces, which are kept and reused the same way.  Both tables find by hash and
compare the bytes, so a hash that two strings share costs time, never a result.

Cuts could change the result.

- Chunks: the pieces on both sides of each join are re-encoded together, once for each pair
  met in the process.  Where the result differs from the two parts', the chunks are merged and encoded
  as one, and merged further, until all joins agree.
- Pieces inside a chunk are used only if the tokenizer's own rules show that it never reads across such a
  cut (``separable``).  For any other tokenizer, chunks are encoded whole and joins are checked on
  whole chunks.

Nothing is shuffled; memory is bounded by the tables' limits and one run of texts.

Defined results: null text counts as empty; an empty text has no tokens and decodes to an empty
text; every row gives one row, whatever its doc_id; other columns are carried only if named.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordhash import NOT_SPACE, U64, mix, ragged, span_hashes, text_runs

CHUNK_PIECES = 32
RUN_BYTES = 1 << 20
TABLE_PIECES = 400_000
TABLE_CHUNKS = 30_000
_ROLL = [U64(pow(0x9E3779B97F4A7C15, j + 1, 1 << 64)) for j in range(16)]
#: Splitting patterns none of whose matches goes on from another character to white space.
_PATTERNS = (r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",)


def tokenizer_file(name: str, folder: str | None = None) -> str:
    """Contents of a tokenizer file, by default of the installed public tokenizers."""
    if folder is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    else:
        path = os.path.join(folder, name)
    with open(path, encoding="utf-8") as f:
        return f.read()


def separable(contents: str) -> bool:
    """May a text be cut between another character and ASCII white space after it, without a change of ids?

    True if no rule reads across such a cut: normalizers that act on characters or on white space alone (no
    composition joins white space to what stands before it), a known splitting pattern (none
    of whose matches goes on from another character to white space), added tokens that hold no white space and
    look at nothing beside them.
    """
    spec = json.loads(contents)

    def steps(part: dict | None, kind: str) -> list[dict]:
        if part is None:
            return []
        return [s for p in part[kind] for s in steps(p, kind)] if part["type"] == "Sequence" else [part]

    for n in steps(spec["normalizer"], "normalizers"):
        if n["type"] not in ("NFC", "Lowercase") and not (n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " "):
            return False
    split = False
    for p in steps(spec["pre_tokenizer"], "pretokenizers"):
        if p["type"] == "ByteLevel" and not p["add_prefix_space"]:
            split |= p["use_regex"]
        elif p["type"] == "Split" and p["pattern"].get("Regex") in _PATTERNS:
            split = True
        else:
            return False
    plain = all(not (a["lstrip"] or a["rstrip"] or a["single_word"]) and not any(c.isspace() for c in a["content"]) for a in spec["added_tokens"])
    return split and plain and spec["model"]["type"] == "BPE" and not spec["model"]["dropout"]


class Table:
    """Byte strings with their ids, found by hash; the most used half stays when it is full."""

    def __init__(self, limit: int):
        self.limit = limit
        self.keys = np.zeros(0, dtype=U64)  # in order; ``row`` is the place of each in what follows
        self.row = np.zeros(0, dtype=np.int64)
        self.text, self.text_at = np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
        self.ids, self.ids_at = np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)
        self.uses = np.zeros(0, dtype=np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each (different) key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        rows = np.where(self.keys[at] == keys, self.row[at], -1)
        self.uses[rows[rows >= 0]] += 1
        return rows

    def add(self, keys: np.ndarray, text: np.ndarray, text_n: np.ndarray, ids: np.ndarray, ids_n: np.ndarray) -> np.ndarray:
        """Take up keys that aren't there yet; their rows."""
        rows = len(self.uses) + np.arange(len(keys))
        self.text_at = np.append(self.text_at, self.text_at[-1] + np.cumsum(text_n))
        self.ids_at = np.append(self.ids_at, self.ids_at[-1] + np.cumsum(ids_n))
        self.text, self.ids = np.append(self.text, text), np.append(self.ids, ids.astype(np.uint32))
        self.uses = np.append(self.uses, np.ones(len(keys), dtype=np.int32))
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.keys, self.row = np.insert(self.keys, at, keys[order]), np.insert(self.row, at, rows[order])
        return rows

    def same(self, rows: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Does the string of each row equal the (not empty) span of ``data``."""
        n = self.text_at[rows + 1] - self.text_at[rows]
        fits = (rows >= 0) & (n == ends - starts)
        differs = np.zeros(len(rows), dtype=bool)
        at = np.flatnonzero(fits)
        if len(at):
            n = n[at]
            unequal = self.text[ragged(self.text_at[rows[at]], n)] != data[ragged(starts[at], n)]
            differs[at] = np.logical_or.reduceat(unequal, np.cumsum(n) - n)
        return fits & ~differs

    def ids_of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after the other, and how many each has (row -1: none)."""
        n = np.where(rows < 0, 0, self.ids_at[rows + 1] - self.ids_at[rows])
        return self.ids[ragged(self.ids_at[rows], n)], n

    def shrink(self) -> None:
        """Between runs: when over the limit, keep the half that was used most."""
        if len(self.uses) <= self.limit:
            return
        keep = np.sort(np.argsort(-self.uses, kind="stable")[: self.limit // 2])
        new = np.full(len(self.uses), -1)
        new[keep] = np.arange(len(keep))
        text_n, ids_n = np.diff(self.text_at)[keep], np.diff(self.ids_at)[keep]
        self.text, self.ids = self.text[ragged(self.text_at[keep], text_n)], self.ids[ragged(self.ids_at[keep], ids_n)]
        self.text_at, self.ids_at = np.append(0, np.cumsum(text_n)), np.append(0, np.cumsum(ids_n))
        self.uses = self.uses[keep] >> 1
        kept = new[self.row] >= 0
        self.keys, self.row = self.keys[kept], new[self.row[kept]]


class Run:
    """What became of a run of texts: ids one after the other and where each text's end, and the decoded texts likewise."""

    def __init__(self, ids: np.ndarray, ids_at: np.ndarray, decoded: list[bytes]):
        self.ids, self.ids_at, self.decoded = ids, ids_at, decoded


class Encoder:
    """A tokenizer with its tables of known pieces, chunks and joins."""

    def __init__(self, contents: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(contents)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.fine = separable(contents)
        self.pieces, self.chunks = Table(TABLE_PIECES), Table(TABLE_CHUNKS)
        #: Pairs of pieces (whole chunks, if not fine) whose join agrees.
        self.good = np.zeros(0, dtype=U64)
        self.looked_up = self.hits = 0
        if self.tokenizer.decoder is None:  # then decoded tokens are joined by a space
            known = self.tokenizer.get_vocab(with_added_tokens=True)
            tokens = [b""] * (max(known.values()) + 1)
            for token, i in known.items():
                tokens[i] = token.encode() + b" "
            self.token_bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
            self.token_at = np.append(0, np.cumsum([len(t) for t in tokens]))

    def encode(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]

    def flat(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.encode(texts)
        n = np.array([len(i) for i in ids], dtype=np.int64)
        return np.fromiter((x for i in ids for x in i), dtype=np.uint32, count=int(n.sum())), n

    def decode(self, ids: np.ndarray, ids_at: np.ndarray) -> list[bytes]:
        if self.tokenizer.decoder is not None:
            return [t.encode() for t in self.tokenizer.decode_batch([ids[a:b].tolist() for a, b in zip(ids_at[:-1], ids_at[1:], strict=True)], skip_special_tokens=False)]
        n = self.token_at[ids + 1] - self.token_at[ids]
        raw = self.token_bytes[ragged(self.token_at[ids], n)].tobytes()
        at = np.append(0, np.cumsum(n))[ids_at].tolist()
        return [raw[a : max(a, b - 1)] for a, b in zip(at[:-1], at[1:], strict=True)]

    def rows_of(self, table: Table, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Row of each span in ``table``, encoded and taken up where new; -1 if its hash is another string's."""
        if not len(keys):
            return np.zeros(0, dtype=np.int64)
        found, first, which = np.unique(keys, return_index=True, return_inverse=True)
        rows = table.find(found)
        new = np.flatnonzero(rows < 0)
        if len(new):
            a, b = starts[first[new]], ends[first[new]]
            ids, n = self.flat([data[i:j].tobytes() for i, j in zip(a.tolist(), b.tolist(), strict=True)])
            rows[new] = table.add(found[new], data[ragged(a, b - a)], b - a, ids, n)
        rows = rows[which]
        return np.where(table.same(rows, data, starts, ends), rows, -1)

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all pieces and which of them begin a text: before ASCII white space that follows no other white space."""
        space = ~NOT_SPACE[data]
        before = np.empty(len(data), dtype=bool)
        before[0], before[1:] = True, space[:-1]
        before[1:] |= (data[:-1] >= 28) & (data[:-1] <= 31)
        high = np.flatnonzero(space & ~before)
        high = high[(data[high - 1] >= 128) & (high > 2)]
        x, y, z = data[high - 3], data[high - 2], data[high - 1]
        # U+0085, U+00A0; U+1680, U+180E, U+2000 to U+207F (white space and marks) and U+3000
        wide = (y == 0xC2) & ((z == 0x85) | (z == 0xA0)) | (x == 0xE1) & ((y == 0x9A) | (y == 0xA0)) | (x == 0xE2) & ((y == 0x80) | (y == 0x81)) | (x == 0xE3) & (y == 0x80)
        before[high[wide]] = True
        cut = space & ~before
        cut[:3] &= data[:3] < 128  # too near the beginning for the test above
        begins = offsets[:-1][offsets[:-1] < offsets[1:]]
        cut[begins] = True
        starts = np.flatnonzero(cut)
        begin = np.zeros(len(data), dtype=bool)
        begin[begins] = True
        return starts, begin[starts]

    def run(self, data: np.ndarray, offsets: np.ndarray) -> Run:
        """Encode and decode the texts of a run."""
        if not len(data):
            return Run(np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64), [b""] * (len(offsets) - 1))
        self.pieces.shrink()
        self.chunks.shrink()
        starts, is_begin = self.cuts(data, offsets)
        ends = np.append(starts[1:], len(data))
        keys = span_hashes(data, starts, ends)
        rolled = np.zeros(len(starts), dtype=U64)
        for j, factor in enumerate(_ROLL):
            rolled += data[np.maximum(starts - 1 - j, 0)].astype(U64) * factor
        chunk_at = np.flatnonzero(is_begin | (mix(rolled) % U64(CHUNK_PIECES) == 0))
        n = np.diff(np.append(chunk_at, len(starts)))
        place = np.arange(len(starts)) - np.repeat(chunk_at, n)
        chunk_keys = mix(np.add.reduceat(mix(keys + place.astype(U64) * U64(0xD1342543DE82EF95)), chunk_at) + n.astype(U64))
        a, b = starts[chunk_at], ends[chunk_at + n - 1]
        rows = self.chunk_rows(chunk_keys, data, a, b, starts, ends, keys, chunk_at, n)
        inner = np.flatnonzero(~is_begin[chunk_at])
        joined = np.ones(len(chunk_at), dtype=bool)
        if self.fine:
            at = chunk_at[inner]
            joined[inner] = self.agree(keys[at - 1], keys[at], data, starts[at - 1], starts[at], ends[at])
        else:
            joined[inner] = self.agree(chunk_keys[inner - 1], chunk_keys[inner], data, a[inner - 1], a[inner], b[inner])
        text_of = np.searchsorted(offsets, a, side="right") - 1
        odd = np.unique(text_of[(rows < 0) | ~joined])
        ids, n = self.chunks.ids_of(rows)
        of_text = np.bincount(text_of, n, len(offsets) - 1).astype(np.int64)
        if len(odd):  # these texts' ids are made by repair
            ends_at = np.cumsum(of_text)
            parts, at = [], 0
            for t in odd.tolist():
                own = np.flatnonzero(text_of == t)
                fixed = self.repaired([data[i:j].tobytes() for i, j in zip(a[own].tolist(), b[own].tolist(), strict=True)])
                parts += [ids[at : ends_at[t] - of_text[t]], fixed]
                at = ends_at[t]
                of_text[t] = len(fixed)
            ids = np.concatenate([*parts, ids[at:]])
        ids_at = np.append(0, np.cumsum(of_text))
        return Run(ids, ids_at, self.decode(ids, ids_at))

    def chunk_rows(self, chunk_keys, data, a, b, starts, ends, keys, chunk_at, n) -> np.ndarray:
        """Row of each chunk in the table of chunks; -1 where it can't be used."""
        found, first, which = np.unique(chunk_keys, return_index=True, return_inverse=True)
        self.looked_up += len(chunk_keys)
        if not self.fine:
            self.hits += len(chunk_keys) - int((self.chunks.find(found) < 0).sum())
            return self.rows_of(self.chunks, chunk_keys, data, a, b)
        rows = self.chunks.find(found)
        new = np.flatnonzero(rows < 0)
        self.hits += len(chunk_keys) - len(new)
        if len(new):
            own = first[new]
            at = ragged(chunk_at[own], n[own])
            piece_rows = self.rows_of(self.pieces, keys[at], data, starts[at], ends[at])
            begins = np.cumsum(n[own]) - n[own]
            whole = np.logical_and.reduceat(piece_rows >= 0, begins)
            ids, ids_n = self.pieces.ids_of(piece_rows)
            ids_n = np.add.reduceat(ids_n, begins)
            if not whole.all():
                ids, ids_n = ids[np.repeat(whole, ids_n)], ids_n[whole]
            own = own[whole]
            rows[new[whole]] = self.chunks.add(found[new[whole]], data[ragged(a[own], b[own] - a[own])], b[own] - a[own], ids, ids_n)
        rows = rows[which]
        return np.where(self.chunks.same(rows, data, a, b), rows, -1)

    def agree(self, left: np.ndarray, right: np.ndarray, data: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Does re-encoding the spans a..b and b..c together give the ids of the two parts; once for each pair of hashes."""
        pair = mix(left * U64(0xA24BAED4963EE407) + right)
        found, first, which = np.unique(pair, return_index=True, return_inverse=True)
        fine = np.isin(found, self.good, assume_unique=True)
        new = np.flatnonzero(~fine)
        if len(new):
            a, b, c = a[first[new]], b[first[new]], c[first[new]]
            table = self.pieces if self.fine else self.chunks
            one = self.rows_of(table, left[first[new]], data, a, b)
            two = self.rows_of(table, right[first[new]], data, b, c)
            usable = (one >= 0) & (two >= 0)
            (x, x_n), (y, y_n) = table.ids_of(np.where(usable, one, -1)), table.ids_of(np.where(usable, two, -1))
            both, n = self.flat([data[i:j].tobytes() for i, j in zip(a.tolist(), c.tolist(), strict=True)])
            fine[new] = usable & (n == x_n + y_n)
            at = np.cumsum(n) - n
            for parts, parts_n, begin in ((x, x_n, at), (y, y_n, at + x_n)):
                own = np.flatnonzero(fine[new] & (parts_n > 0))
                if len(own):
                    k = parts_n[own]
                    differs = parts[ragged((np.cumsum(parts_n) - parts_n)[own], k)] != both[ragged(begin[own], k)]
                    fine[new[own]] &= ~np.logical_or.reduceat(differs, np.cumsum(k) - k)
            if len(self.good) > TABLE_PIECES:
                self.good = self.good[:0]
            self.good = np.union1d(self.good, found[fine])
        return fine[which]

    def repaired(self, parts: list[bytes]) -> np.ndarray:
        """Merge parts of a text across joins that don't agree, until all do; the ids of what is left."""
        out: list[tuple[bytes, list[int]]] = []
        for part, ids in zip(parts, self.encode(parts), strict=True):
            out.append((part, ids))
            while len(out) > 1:
                (x, i), (y, j) = out[-2:]
                both = self.encode([x + y])[0]
                if both == i + j:
                    break
                out[-2:] = [(x + y, both)]
        return np.array([i for _, ids in out for i in ids], dtype=np.uint32)


_encoders: dict[str, Encoder] = {}


def _encoder(contents: str) -> Encoder:
    key = hashlib.sha256(contents.encode()).hexdigest()
    if key not in _encoders:
        _encoders[key] = Encoder(contents)
    return _encoders[key]


def _encode(contents, with_tokens: bool, others: list[str]):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(contents.value)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            for lo, hi, data, offsets in text_runs(column, RUN_BYTES):
                out = encoder.run(data, offsets)
                raw, at = out.ids.astype("<u4").tobytes(), (4 * out.ids_at).tolist()
                shas = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
                decoded_shas = [hashlib.sha256(t).hexdigest() for t in out.decoded]
                more = []
                if with_tokens:
                    more = [pa.ListArray.from_arrays(pa.array(out.ids_at.astype(np.int32)), pa.array(out.ids.astype(np.int32))), pa.array([t.decode() for t in out.decoded], pa.string())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(out.ids_at)), pa.array(shas, pa.string()), pa.array(decoded_shas, pa.string()), *more, *(batch.column(batch.schema.get_field_index(c)).slice(lo, hi - lo) for c in others)],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_tokens else []), *others],
                )

    return go


def encode(docs: DataFrame, contents: str, with_tokens: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row: doc_id, n_tokens, ids_sha256, decoded_sha256 and, ``with_tokens``, ids and decoded.

    ``contents``: a tokenizers JSON file's text (a few MB; broadcast).  ``keep``: columns to carry along."""
    shared = docs.sparkSession.sparkContext.broadcast(contents)
    others = [f"other_{c}" for c in keep]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *(F.col(c).alias(f"other_{c}") for c in keep))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_tokens else "")
    schema += "".join(f", `other_{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(_encode(shared, with_tokens, others), schema).withColumnsRenamed({f"other_{c}": c for c in keep})
