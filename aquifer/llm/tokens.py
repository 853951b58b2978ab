"""Token ids of whole texts with a public tokenizer's file.

The library is asked once for each different chunk of text that a task meets, not once for each place.
A chunk runs from the end of one word to the end of the next: white space, then other characters. Both
kinds of tokenizer used here end a piece where white space follows other characters, and where a full stop or
a comma follows a letter or a digit, so the ids of a text are those of its chunks, one after the other. A text
with white space outside ASCII goes to the library whole.

New chunks of plain characters are cut into pieces by the file's own rules, and the library's BPE model is asked
for many pieces at once, as one string in which no merge reaches over the end of a piece (`Joined`). All others, and
all chunks of a file with other rules, go through the library's whole tokenizer.
"""

from __future__ import annotations

import array
import json
import os
import re

import numpy as np

SPACE = r" \t\n\r\x0b\x0c"
#: What stands before a full stop or comma that starts a chunk: an ASCII letter or digit, or a letter of Latin-1.
BEFORE_STOP = (rb"[A-Za-z0-9]", rb"\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]")
#: A chunk: ASCII white space and what follows it, up to a stop if that ends a piece; or white space at the end.
CHUNK = re.compile(rb"[%b]*+[^%b.,]++(?:(?<=%b)|(?<=%b)|[^%b]*+)|[%b]*+[^%b]++|[%b]++" % (
    *[SPACE.encode()] * 2, *BEFORE_STOP, *[SPACE.encode()] * 4))
#: A stop that starts a chunk.
STOP = re.compile(rb"[.,](?:(?<=%b.)|(?<=%b.))" % BEFORE_STOP)
#: UTF-8 of white space outside the six, and of separators that libraries disagree about, by their first bytes.
RARE = {
    **{bytes([c]): [b""] for c in range(0x1C, 0x20)}, b"\xc2": [b"\x85", b"\xa0"], b"\xe1": [b"\x9a\x80"],
    b"\xe2": [b"\x81\x9f", *(bytes([0x80, c]) for c in (*range(0x80, 0x8C), 0xA8, 0xA9, 0xAF))],
    b"\xe3": [b"\x80\x80"], b"\xef": [b"\xbb\xbf"]}
#: First bytes of the UTF-8 of marks that may combine with an ASCII letter.
MARKS = (b"\xcc", b"\xcd")

#: Plain characters, which every version of Unicode classes alike, which no normal form changes and which have one
#: lower-case letter at most: letters, and others that are neither letters, digits nor white space.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f\u0400-\u0481"
SIGNS = (r"!-/:-@\[-`{-~" "\u00a1-\u00a9\u00ab\u00ac\u00ae-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf\u00d7\u00f7"
         "\u2010-\u2027\u2030-\u205e\u20ac")
NOT_PLAIN = re.compile(f"[^\0{SPACE}0-9{LETTERS}{SIGNS}]")

#: The rules of the two kinds of file, as the files state them, and as patterns over plain characters. Byte 0
#: ends a chunk and belongs to its last piece.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
BYTE_RULES = (None, {**BYTE_LEVEL, "use_regex": True})
WORD_RULES = (
    {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
         "behavior": "Removed", "invert": True}, {**BYTE_LEVEL, "use_regex": False}]})
BYTE_PIECE = re.compile(rf"(?:'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[0-9]+| ?[^\0{SPACE}{LETTERS}0-9]+"
                        rf"|[{SPACE}]+(?![^\0{SPACE}])|[{SPACE}]+)\0?")
WORD_PIECE = re.compile(rf"(?:'(?:[stmd]|re|ve|ll)|[{LETTERS}]+|[0-9]|[^\0{SPACE}{LETTERS}0-9]+)\0?")


def rare(text: bytes) -> bool:
    return any(first in text and any(first + rest in text for rest in more) for first, more in RARE.items())


def byte_characters() -> np.ndarray:
    """Code point of the character that stands for each byte in a byte-level vocabulary."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    codes = np.zeros(256, np.uint32)
    codes[kept] = kept
    codes[codes == 0] = np.arange(256, 512 - len(kept))
    return codes


class Joined:
    """The library's BPE model of a file, asked for the pieces of many chunks in one string.

    Where the file marks the last character of a piece by a suffix, that character and the suffix become one private
    character, in the vocabulary, the merges and the string: the file has no merge behind it. Else a
    private character of its own, which is in no merge, follows each piece, and its id is taken out again.
    """

    PRIVATE = 0xF0000
    CHUNKS = 200  # to a string: the model's queue grows with it

    def __init__(self, spec: dict):
        from tokenizers import Tokenizer, models

        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.piece = WORD_PIECE if self.suffix else BYTE_PIECE
        self.codes = byte_characters()
        vocab = {self.renamed(t): k for t, k in model["vocab"].items()}
        merges = [tuple(map(self.renamed, m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        if not self.suffix:
            vocab[chr(self.PRIVATE)] = max(vocab.values()) + 1
        self.ends_piece = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_piece[[k for t, k in vocab.items() if ord(t[-1]) >= self.PRIVATE]] = True
        self.codes[[0, 1]] = self.PRIVATE  # ends of pieces; plain characters do not include these two bytes
        self.tokenizer = Tokenizer(models.BPE(vocab, merges))

    @staticmethod
    def of(spec: dict, drops_space: bool) -> Joined | None:
        """None if the file has other rules than the two known here."""
        model, rules = spec["model"], (spec.get("normalizer"), spec.get("pre_tokenizer"))
        simple = model.get("type") == "BPE" and not any(model.get(k) for k in (
            "dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        suffix = model.get("end_of_word_suffix") or ""
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        known = rules == (WORD_RULES if suffix else BYTE_RULES) and drops_space == bool(suffix)
        if not (simple and known and spec.get("post_processor") is None):
            return None
        characters = [chr(c) + e for c in byte_characters() for e in {"", suffix}]
        whole = all(c in model["vocab"] for c in characters)
        return Joined(spec) if whole and not (suffix and any(a.endswith(suffix) for a, _ in pairs)) else None

    def renamed(self, token: str) -> str:
        """A token in this model's vocabulary: its last character and the suffix are one."""
        n = len(self.suffix)
        marked = n and len(token) > n and token.endswith(self.suffix)
        return token[:-n - 1] + chr(self.PRIVATE + ord(token[-n - 1])) if marked else token

    def ids(self, chunks: list[str]) -> list[bytes]:
        """The ids of chunks of plain characters."""
        return [x for lo in range(0, len(chunks), self.CHUNKS) for x in self.group(chunks[lo:lo + self.CHUNKS])]

    def group(self, chunks: list[str]) -> list[bytes]:
        text = "\0".join(chunks) + "\0"
        pieces = self.piece.findall(text.lower() if self.suffix else text)
        raw = np.frombuffer("\1".join(pieces).replace("\0\1", "\0").encode(), np.uint8)
        ends = np.flatnonzero(raw < 2)  # byte 0: of a piece and its chunk, byte 1: of a piece within a chunk
        codes = self.codes[raw]
        if self.suffix:
            codes[ends - 1] += np.uint32(self.PRIVATE)
            codes = np.delete(codes, ends)
        got = self.tokenizer.encode_batch_fast([codes.tobytes().decode("utf-32-le")], add_special_tokens=False)
        ids = np.array(got[0].ids, np.uint32)
        last = self.ends_piece[ids]
        upto = np.flatnonzero(last) + 1
        if not self.suffix:
            ids, upto = ids[~last], upto - np.arange(1, len(upto) + 1)
        cuts = (4 * upto[raw[ends] == 0]).tolist()
        if len(upto) != len(ends) or len(cuts) != len(chunks):
            raise ValueError("pieces and ids do not go together")
        out = ids.tobytes()
        return [out[a:b] for a, b in zip([0, *cuts], cuts)]


class Encoder(dict):
    """Chunk -> its ids as little-endian unsigned 32-bit integers, looked up in the library when it is new.

    drops_space: the tokenizer gives no ids for white space, so words alone are looked up, and lower-cases, so
    ASCII letters are lower-cased first.
    limit: chunks in each of the two generations that are remembered.
    """

    def __init__(self, path: str, drops_space: bool, limit: int = 250_000):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            self.joined = Joined.of(json.load(f), drops_space)
        self.drops_space, self.limit = drops_space, limit
        self.old: dict[bytes, bytes] = {}
        self.asked: dict[bytes, bytearray] = {}

    def __missing__(self, chunk: bytes) -> bytes | bytearray:
        got = self.old.get(chunk)
        if got is None:  # an empty answer, filled when the library has been asked
            got = self.asked[chunk] = bytearray()
        self[chunk] = got
        return got

    def library(self, texts: list[bytes]) -> list[bytes]:
        got = self.tokenizer.encode_batch([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [array.array("I", e.ids).tobytes() for e in got]

    def looked_up(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of chunks, by the joined model where they are plain."""
        whole = b"\0".join(chunks)
        if self.joined is None or whole.count(b"\0") >= max(1, len(chunks)):  # a chunk with byte 0
            return self.library(chunks)
        texts = whole.decode("utf-8", "replace")
        plain = [True] * len(chunks)
        if NOT_PLAIN.search(texts):
            plain = [not NOT_PLAIN.search(t) for t in texts.split("\0")]
        fast = iter(self.joined.ids([t for t, p in zip(texts.split("\0"), plain) if p]))
        slow = iter(self.library([c for c, p in zip(chunks, plain) if not p]))
        return [next(fast if p else slow) for p in plain]

    def chunks(self, text: bytes) -> list[bytes]:
        if not self.drops_space:
            return CHUNK.findall(text)
        if not any(map(text.__contains__, MARKS)):
            text = text.lower()
        return STOP.sub(rb" \g<0>", text).split()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, in order."""
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()
        parts = [self.library([t]) if rare(t) else list(map(self.__getitem__, self.chunks(t))) for t in texts]
        new = list(self.asked)
        for chunk, ids in zip(new, self.looked_up(new)):
            self.asked[chunk] += ids
            self[chunk] = ids
        self.asked.clear()
        return [b"".join(p) for p in parts]


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, drops_space: bool) -> Encoder:
    """This worker process's encoder of a tokenizer file; it serves all tasks that the process runs."""
    key = (path, drops_space)
    if key not in _encoders:
        _encoders[key] = Encoder(path, drops_space)
    return _encoders[key]


def narrow(ids: np.ndarray) -> bytes:
    """Ids as stored between stages: 16 bits each if all fit, else 32; a first byte tells the width."""
    if ids.size == 0 or ids.max() < 1 << 16:
        return b"\x02" + ids.astype("<u2").tobytes()
    return b"\x04" + ids.astype("<u4").tobytes()


def widen(stored: bytes) -> np.ndarray:
    return np.frombuffer(stored, "<u2" if stored[0] == 2 else "<u4", offset=1).astype(np.uint32)
