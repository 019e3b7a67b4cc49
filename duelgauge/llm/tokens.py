"""Token ids of whole texts through the tokenizers library, with a worker-wide memory of pieces.

Both vocabularies end a token before white space and between a letter or digit and a punctuation mark, so
the ids of a text are the ids of its pieces in order. The texts of a block are cut together on their bytes;
only the different pieces of a block are looked up, and only those not known are encoded, many in one call,
joined by a separator that stands for exactly one id. Texts that hold an added token ("<|endoftext|>"), and
all texts of a vocabulary that cuts in another way, are encoded whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

MEMORY_BYTES = 96 << 20  # of all known pieces of a Python worker together
ASKED_SLOTS = 1 << 22  # one byte each, by hash: pieces asked for since the memory is three quarters full
BLOCK_BYTES = 2 << 20  # of text encoded at a time; an unknown piece is encoded once in a block
PIECE_BYTES = 150  # what Python takes for a piece, its ids and their entry, but for their characters; 138 to 157 in all, as measured
JOINED, JOINED_LETTERS = 50, 200  # pieces in a call; longer texts take the library more time a piece

# Pre-tokenizers as the library states them; both regular expressions look ahead only at white space.
GPT2 = '{"type":"ByteLevel","add_prefix_space":false,"trim_offsets":true,"use_regex":true}'
WORDS = (
    r'{"type":"Sequence","pretokenizers":[{"type":"Split","pattern":{"Regex":"'
    r"'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
    r'"},"behavior":"Removed","invert":true},{"type":"ByteLevel","add_prefix_space":false,"trim_offsets":true,"use_regex":false}]}'
)
NORMAL = r'{"type":"Sequence","normalizers":[{"type":"NFC"},{"type":"Replace","pattern":{"Regex":"\\s+"},"content":" "},{"type":"Lowercase"}]}'

BLANK, LETTER, MARK, INNER = 1, 2, 3, 4
KIND = np.zeros(256, np.uint8)  # by byte; 0: control characters and first bytes of longer characters
KIND[0x21:0x7F] = MARK
KIND[[b for b in range(128) if chr(b).isalnum()]] = LETTER
KIND[list(b" \t\n\x0b\x0c\r")] = BLANK
KIND[0x80:0xC0] = INNER
# U+00C0 to U+024F and U+0400 to U+047F are letters but for two signs; one of them turns lower-case into a letter and an accent.
LETTER_LEADS = np.isin(np.arange(256), [*range(0xC3, 0xCA), 0xD0, 0xD1])
NO_LETTERS = [0xC397, 0xC3B7, 0xC4B0]
# One run of letters that composition leaves as they are and that have one lower-case letter each.
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ɏЀ-ѿ]+")
LETTERS_SPACED = re.compile(" ?" + LETTERS.pattern)
JOINABLE = re.compile(r" ?\S(?:[^\n]*\S)?")


def _byte_letters() -> np.ndarray:
    """The character (UTF-16) by which byte-level vocabularies write a byte; 0 stays, as a separator."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = np.zeros(256, "<u2")
    out[shown] = shown
    hidden = [b for b in range(256) if b not in set(shown)]
    out[hidden] = 256 + np.arange(len(hidden))
    out[0] = 0
    return out


BYTE_LETTERS = _byte_letters()


class Pieces(dict):
    """Known pieces; an unknown one stands for itself and is noted."""

    def __init__(self):
        super().__init__()
        self.wanted: list[str] = []

    def __missing__(self, piece: str) -> str:
        self.wanted.append(piece)
        return piece


class PieceEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes. `spaces`: white space is part of the ids."""

    def __init__(self, path: str, spaces: bool):
        import tokenizers

        # Python workers outlive a task: what they learned is kept with the library they share.
        kept = tokenizers.__dict__.setdefault("_known_pieces", {})
        self.kept = kept
        if (path, "tokenizer") not in kept:
            whole = tokenizers.Tokenizer.from_file(path)
            letters = tokenizers.Tokenizer(whole.model)
            letters.pre_tokenizer = tokenizers.pre_tokenizers.CharDelimiterSplit(" ")
            kept[path, "tokenizer"] = whole, letters
        self.tokenizer, self.letters = kept[path, "tokenizer"]
        self.spaces = spaces
        self.known: Pieces = kept.setdefault((path, spaces), Pieces())
        self.separator = "\n" if spaces else "|"
        self.joint = "\n" if spaces else " | "
        mark = self._ids(self.separator)
        self.mark = mark[0] if len(mark) == 1 else None
        self.line_end = self._whole("\n") if spaces else b""
        self.letter_mark = self._written(self.separator)
        mark = self.letters.encode(self.letter_mark, add_special_tokens=False).ids
        self.letter_mark_id = mark[0] if len(mark) == 1 else None
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        steps = [s and s.__getstate__().decode() for s in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)]
        self.cuts = steps == ([None, GPT2] if spaces else [NORMAL, WORDS]) and self.tokenizer.post_processor is None

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _whole(self, text: str) -> bytes:
        return np.array(self._ids(text), "<u4").tobytes()

    @staticmethod
    def _written(text: str) -> str:
        return BYTE_LETTERS[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-16-le")

    def _cut(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes to encode, the starts of pieces in them, and the edges of the texts there."""
        kind = KIND[data]
        first = np.zeros(len(data) + 1, bool)
        before, after = kind[:-1], kind[1:]
        at = np.flatnonzero((after == MARK) & ((before == LETTER) | (before == INNER))) + 1
        inner = kind[at - 1] == INNER
        lead, last = data[at - 2], data[at - 1]
        first[at[~inner | (LETTER_LEADS[lead] & ~np.isin(lead.astype(np.uint16) << 8 | last, NO_LETTERS))]] = True
        if not self.spaces:  # white space only parts pieces
            first[1:-1] |= before == BLANK
            first[edges] = True
            kept = kind != BLANK
            place = np.concatenate(([0], np.cumsum(kept)))
            data, edges, pieces = data[kept], place[edges], place[first]
            first = np.zeros(len(data) + 1, bool)
            first[pieces] = True
            return data, np.flatnonzero(first[:-1]), edges
        # White space starts a piece if what is before it is certainly not white space.
        at = np.flatnonzero((after == BLANK) & (before >= LETTER)) + 1
        inner = at[kind[at - 1] == INNER]
        first[at] = True
        third, second, last = data[np.maximum(inner - 3, 0)], data[inner - 2], data[inner - 1]
        long = KIND[second] == INNER
        odd = long & (third == 0xE1) & ((second == 0x9A) | (second == 0xA0))
        odd |= long & (third == 0xE2) & ((second == 0x81) | ((second == 0x80) & ~((last >= 0x90) & (last < 0xA8))))
        odd |= (long & (third == 0xE3) & (second == 0x80)) | (second == 0xC2)
        first[inner[odd]] = False
        first[edges] = True
        return data, np.flatnonzero(first[:-1]), edges

    def _joined(self, found: dict[str, bytes], wanted: list[str], size: int, mark: int, ids_of: Callable[[list[str]], list[int]]) -> None:
        for at in range(0, len(wanted), size):
            part = wanted[at : at + size]
            ids = np.array(ids_of(part), "<u4")
            ends = np.flatnonzero(ids == mark)
            if len(ends) != len(part) - 1:  # a piece holds the mark's id by another way
                found.update((w, self._whole(w)) for w in part)
                continue
            starts = (4 * np.concatenate(([0], ends + 1))).tolist()
            stops = (4 * np.concatenate((ends, [len(ids)]))).tolist()
            raw = ids.tobytes()
            found.update((w, raw[a:b]) for w, a, b in zip(part, starts, stops))

    def _letter_ids(self, part: list[str]) -> list[int]:
        """Runs of letters need no expression to be cut by: the library's model alone encodes them."""
        text = self._written("\0".join(part)).replace("\0", f" {self.letter_mark} ")
        return self.letters.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _all_ids(self, part: list[str]) -> list[int]:
        return self.tokenizer.encode_batch_fast([self.joint.join(part)], add_special_tokens=False)[0].ids

    def _learn(self, wanted: list[str]) -> dict[str, bytes]:
        """Ids of pieces not seen before."""
        found: dict[str, bytes] = {}
        led = [w for w in wanted if self.spaces and w[:1] == "\n" and not w[1:2].isspace() and "\n" not in w[1:]]
        if led:  # a line end is ids of its own
            heads = self._learn(list({w[1:] for w in led} - {""})) | {"": b""}
            found |= {w: self.line_end + heads[w[1:]] for w in led}
            wanted = [w for w in wanted if w not in found]
        if self.letter_mark_id is not None:
            if self.spaces:
                runs = [w for w in wanted if LETTERS_SPACED.fullmatch(w)]
                self._joined(found, runs, JOINED_LETTERS, self.letter_mark_id, self._letter_ids)
            else:
                runs = {w: w.lower() for w in wanted if LETTERS.fullmatch(w)}
                low: dict[str, bytes] = {}
                self._joined(low, list(dict.fromkeys(runs.values())), JOINED_LETTERS, self.letter_mark_id, self._letter_ids)
                found |= {w: low[v] for w, v in runs.items()}
            wanted = [w for w in wanted if w not in found]
        alone = [w for w in wanted if self.mark is None or self.separator in w or not JOINABLE.fullmatch(w)]
        found |= {w: self._whole(w) for w in alone}
        self._joined(found, [w for w in wanted if w not in found], JOINED, self.mark, self._all_ids)
        return found

    def _fill(self, known: Pieces) -> dict[str, bytes]:
        """Learn the pieces that were asked for in vain; what a full memory cannot take is only returned.

        Most pieces of a large corpus occur once. So that they do not fill the memory, its last quarter takes
        only pieces that an earlier block asked for, too.
        """
        wanted, known.wanted = list(dict.fromkeys(known.wanted)), []
        fresh = self._learn(wanted)
        held, keep = self.kept.get("bytes", 0), fresh
        if held > MEMORY_BYTES * 3 // 4:
            seen = self.kept.setdefault("asked", bytearray(ASKED_SLOTS))
            keep = {}
            for w, i in fresh.items():
                at = hash(w) % ASKED_SLOTS
                if seen[at]:
                    keep[w] = i
                else:
                    seen[at] = 1
        taken = sum(PIECE_BYTES + 2 * len(w) + len(i) for w, i in keep.items())
        if held + taken <= MEMORY_BYTES:
            known |= keep
            self.kept["bytes"] = held + taken
        return fresh

    def encode(self, texts: list[str | None] | pa.Array | pa.ChunkedArray) -> list[bytes]:
        column = texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, pa.large_string())
        if not self.cuts:
            return [self._whole(t) if t else b"" for t in column.to_pylist()]
        column = column.fill_null("").cast(pa.large_binary())
        column = pa.concat_arrays(column.chunks or [pa.array([], pa.large_binary())]) if isinstance(column, pa.ChunkedArray) else column
        edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        size = int(edges[-1] - edges[0])
        if not size:
            return [b""] * len(column)
        data = np.frombuffer(column.buffers()[2], np.uint8)[edges[0] : edges[-1]]
        data, starts, places = self._cut(data, edges - edges[0])
        offsets = np.concatenate((starts, [len(data)])).astype(np.int64)
        cut = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
        cut = cut.dictionary_encode()
        got = list(map(self.known.__getitem__, cut.dictionary.cast(pa.large_string()).to_numpy(zero_copy_only=False).tolist()))
        if self.known.wanted:
            new = self._fill(self.known)
            got = [x if type(x) is bytes else new[x] for x in got]
        ids = pa.array(got, pa.large_binary()).take(cut.indices)
        raw = memoryview(ids.buffers()[2]) if len(ids) else memoryview(b"")
        ends = np.frombuffer(ids.buffers()[1], np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        bounds = ends[np.searchsorted(starts, places)].tolist()
        out = [bytes(raw[a:b]) for a, b in zip(bounds, bounds[1:])]
        for k in self._with_added(column, edges):
            out[k] = self._whole(column[k].as_py().decode())
        return out

    def _with_added(self, column: pa.Array, edges: np.ndarray) -> list[int]:
        """Texts that hold an added token, which may be cut anywhere."""
        raw = bytes(memoryview(column.buffers()[2])[int(edges[0]) : int(edges[-1])])
        found = set()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                k = int(np.searchsorted(edges, edges[0] + at, side="right")) - 1
                found.add(k)
                at = raw.find(token, max(at + 1, int(edges[k + 1] - edges[0])))
        return sorted(found)


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
