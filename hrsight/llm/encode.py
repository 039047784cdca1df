"""Token ids by the tokenizers library, with a worker-wide cache of text units.

For a byte-level BPE file whose pre-tokenizer is the plain byte-level split and
that has no normaliser, a text is cut before every blank that follows a
non-blank character. The pre-tokenizer always cuts there as well, so the ids of
a text are the ids of its units one after the other, and each distinct unit is
encoded by the library once per worker. Other tokenizer files get whole texts.

The cache is two generations of at most `YOUNG` units; it lives as long as the
Python worker and only saves time, it never changes a result.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

YOUNG = 600_000
_AFTER_BLANK = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S) ")
# Letters of the Latin blocks (for which all Unicode versions agree) and a tail of ASCII signs other than
# the apostrophe: exactly two pre-tokens, or one without the tail.
_UNIT = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@\[-`{-~]*)").fullmatch
_encoders: dict = {}


def byte_symbols():
    """The byte-level alphabet: printable bytes stand for themselves, others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return {b: chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)}


def encoder(path, what="ids"):
    """The worker's encoder for a tokenizer file; `what` is 'ids' or 'lengths'."""
    if (path, what) not in _encoders:
        _encoders[path, what] = Encoder(path, what)
    return _encoders[path, what]


class Encoder:
    def __init__(self, path, what):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.lengths = what == "lengths"
        self.units = False
        if path.endswith(".model"):
            import sentencepiece

            self.piece = sentencepiece.SentencePieceProcessor(model_file=path)
            self.width = np.dtype("<u4")
            return
        from tokenizers import Tokenizer

        self.piece = None
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.width = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        spec = json.loads(self.tok.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.units = (spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                      and not pre.get("add_prefix_space") and spec["model"]["type"] == "BPE"
                      and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]))
        self.model = self.tok.model
        self.map = {b: ord(s) for b, s in byte_symbols().items()}
        self.young, self.old = {}, {}
        self.first = {}
        self.bare, self.tails = {}, {"": 0 if self.lengths else b""}
        self.line = self.value(self.tok.encode("\n", add_special_tokens=False).ids)
        self.code = "H" if self.width.itemsize == 2 else "I"

    def value(self, ids):
        return len(ids) if self.lengths else np.array(ids, dtype=self.width).tobytes()

    def load(self, units, lengths):
        """Start the cache from a table of frequent units (lengths mode)."""
        if not self.young:
            self.young.update(zip(units, lengths))

    def whole(self, texts):
        if self.piece is not None:
            return [self.value(x) for x in self.piece.encode(texts, num_threads=1)]
        return [self.value(e.ids) for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def word(self, w):
        """A word of letters, with or without a blank before it: one pre-token, straight to the BPE model."""
        mapped = w.replace(" ", "Ġ") if w.isascii() else w.encode().decode("latin-1").translate(self.map)
        made = self.model.tokenize(mapped)
        return len(made) if self.lengths else array(self.code, [t.id for t in made]).tobytes()

    def tail(self, signs):
        v = self.tails.get(signs)
        if v is None:
            if len(self.tails) > 10_000:
                self.tails.clear()
            v = self.tails[signs] = self.value(self.tok.encode(signs, add_special_tokens=False).ids)
        return v

    def stem(self, w):
        """' ' + w for letters only, kept in the cache."""
        v = self.young.get(w)
        if v is None:
            v = self.old.get(w)
            if v is None:
                v = self.word(" " + w)
            self.young[w] = v
        return v

    def start(self, w):
        """w for letters only, at the beginning of a line."""
        v = self.bare.get(w)
        if v is None:
            if len(self.bare) > YOUNG // 4:
                self.bare.clear()
            v = self.bare[w] = self.word(w)
        return v

    def fill(self, missing):
        """{unit: value} of units that the young generation doesn't hold; most are kept in it."""
        if len(self.young) + len(missing) > YOUNG:
            self.old, self.young = self.young, {}
        young, old, rest, out = self.young, self.old, [], {}
        for p in missing:
            v = old.get(p)
            if v is None:
                m = _UNIT(p)
                if m is not None:
                    v = self.stem(m[1])
                    if m[2]:
                        v = v + self.tail(m[2])
                elif "\n" in p and all(parts := [_UNIT(x) for x in p.split("\n")]):
                    v = self.stem(parts[0][1]) + self.tail(parts[0][2])
                    for m in parts[1:]:
                        v = v + self.line + self.start(m[1]) + self.tail(m[2])
                    out[p] = v  # hardly any of these comes again
                    continue
                else:
                    rest.append(p)
                    continue
            out[p] = young[p] = v
        for i in range(0, len(rest), 1000):
            part = rest[i:i + 1000]
            for p, e in zip(part, self.tok.encode_batch_fast([" " + p for p in part], add_special_tokens=False)):
                out[p] = young[p] = self.value(e.ids)
        return out

    def heads(self, p):
        """The first unit of a text, which has no blank before it."""
        v = self.first.get(p)
        if v is None:
            if len(self.first) > 50_000:
                self.first.clear()
            v = self.first[p] = self.value(self.tok.encode(p, add_special_tokens=False).ids)
        return v

    def encode(self, texts):
        """For each text its token count ('lengths') or its ids as little-endian bytes ('ids'); null is empty."""
        texts = ["" if t is None else t for t in texts]
        if not self.units:
            return self.whole(texts)
        cut = [_CUT.split(t) if _AFTER_BLANK.search(t) else t.split(" ") for t in texts]
        out = []
        for pieces in cut:
            head = self.heads(pieces[0])
            del pieces[0]
            found = list(map(self.young.get, pieces))
            if None in found:
                missing = dict.fromkeys(p for p, v in zip(pieces, found) if v is None)
                new = self.fill(missing)
                found = [new[p] if v is None else v for p, v in zip(pieces, found)]
            out.append(head + sum(found) if self.lengths else head + b"".join(found))
        return out
