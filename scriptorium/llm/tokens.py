"""Token ids of whole texts with a public tokenizer file, as little-endian unsigned bytes.

The ids are those of the tokenizers library with add_special_tokens=False, for any tokenizer file. A byte-level
BPE with the common pre-token pattern encodes every pre-token by itself, so with such a file (`cuttable`) a text
of common Latin characters is cut into its pre-tokens here, and their ids come from a bounded memo of what the
library's model answers. Of a text with other characters only the chunks between spaces that hold them go to the
library: a space begins a pre-token wherever it does not stand within a run of white space. Texts where it does,
texts that hold an added token of the file, and all texts with any other file go to the library whole.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable
from pathlib import Path

from scriptorium.llm import memory

#: The pre-token pattern of byte-level BPE files, written out for common characters, letters first.
LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
PRETOKEN = re.compile(rf" ?[{LETTER}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\s{LETTER}0-9]+|\s+(?!\S)|\s+")
UNCOMMON = re.compile(rf"[^\t\n\r\x20-\x7e{LETTER}]")
#: A space after white space that no visible character follows: a cut there could fall inside a pre-token.
WITHIN = re.compile(r"\s (?!\S)")
#: Entries of one generation of a memo (two are held), and the longest text that is an entry.
MEMO, LONGEST = 300_000, 64


def cuttable(file: dict) -> bool:
    """Whether a tokenizer file is a byte-level BPE that encodes each pre-token of the common pattern by itself."""
    before, model = file.get("pre_tokenizer") or {}, file.get("model") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    whole = not any(file.get(k) for k in ("normalizer", "truncation", "padding"))
    return plain and whole and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))


def byte_letters() -> dict[int, str]:
    """The character that byte-level files write for each byte: itself where it is visible, else one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Memo(dict):
    """Text to the bytes of its ids, asked for at first sight; what the generation before knows is taken over when it is met again."""

    def __init__(self, ask, before: dict | None = None):
        self.ask, self.before = ask, {} if before is None else before

    def __missing__(self, text: str) -> bytes:
        ids = self.before.get(text)
        if ids is None:
            ids = self.ask(text)
        if len(text) <= LONGEST:
            self[text] = ids
        return ids

    def next(self) -> Memo:
        """This memo, or a new generation where it is full."""
        if len(self) < MEMO:
            return self
        self.before = {}
        return Memo(self.ask, self)


class Encoder:
    """Texts to bytes of ids, `width` bytes an id: 2 where all ids of the vocabulary fit, else 4."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        file = json.loads(Path(path).read_text(encoding="utf-8"))
        self.tok = Tokenizer.from_file(path)
        self.model, self.letters = self.tok.model, byte_letters()
        self.width = 2 if max(self.tok.get_vocab(with_added_tokens=True).values(), default=0) < 1 << 16 else 4
        self.kind = "H" if self.width == 2 else "I"
        self.cut = cuttable(file)
        self.added = [t["content"] for t in file.get("added_tokens") or ()]
        self.forget()

    def forget(self) -> None:
        """Let go of the memos."""
        self.words, self.chunks = Memo(self.ask_model), Memo(self.ask)

    def ask(self, text: str) -> bytes:
        """Any text."""
        return array(self.kind, self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def ask_model(self, pretoken: str) -> bytes:
        """One pre-token."""
        spelt = pretoken.encode().decode("latin-1").translate(self.letters)
        return array(self.kind, [t.id for t in self.model.tokenize(spelt)]).tobytes()

    def end(self, token_id: int) -> bytes:
        return int(token_id).to_bytes(self.width, "little")

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        out: list[bytes] = []
        words, cut = self.words, PRETOKEN.findall
        for t in texts:
            if not t:
                out.append(b"")
            elif not self.cut or any(x in t for x in self.added):
                out.append(self.ask(t))
            elif not UNCOMMON.search(t):
                out.append(b"".join([words[w] for w in cut(t)]))
            elif WITHIN.search(t):
                out.append(self.ask(t))
            else:
                first, *rest = t.split(" ")
                parts = []
                for chunk in (first, *(f" {x}" for x in rest)):
                    parts += [self.chunks[chunk]] if UNCOMMON.search(chunk) else [words[w] for w in cut(chunk)]
                out.append(b"".join(parts))
        self.words, self.chunks = self.words.next(), self.chunks.next()
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and file, until a task of another kind begins."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    memory.kept["encoders"] = _encoders.clear
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_tokenizer() -> str:
    """Production parameter of the queries: a public byte-level BPE vocabulary that the box provides."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
