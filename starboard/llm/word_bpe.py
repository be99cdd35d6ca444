"""Ids of the lower-casing word BPE tokenizer, for many texts whose words recur."""

from __future__ import annotations

import functools
import re
import struct

from starboard.llm.common import REMEMBERED_BYTES, Remembered

# Chunks of ASCII and Latin-1 letters, digits and ASCII signs need no Unicode normalisation.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
# Fixed value: the tokenizer's own split, for plain lower-case chunks.
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


class WordBpe:
    """``ids(text)`` is what the tokenizer gives, as little-endian unsigned 32-bit values.

    The tokenizer drops white space and never joins what it separates, so a text's ids are those of its chunks
    between ASCII white space, and ids of short chunks are remembered, in ``remembered`` bytes. A text with the
    string of a special token goes to the tokenizer as a whole, which gives that token.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED_BYTES):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        added = self.whole.get_added_tokens_decoder().values()
        # Found in the text as it stands, before it is put into lower case.
        self.special = re.compile(b"|".join(re.escape(t.content.encode()) for t in added) or b"(?!)")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.chunks = Remembered(self._chunk, most=remembered)
        letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.as_bytes = {c: letters.pre_tokenize_str(c)[0][0] for c in map(chr, range(33, 256))}

    def _chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8", "replace")
        if text.isascii() and text.isalpha():
            ids = [t.id for t in self.model.tokenize(text)]
        elif PLAIN.fullmatch(text):
            pieces = PIECE.findall(text.lower())
            if not text.isascii():
                pieces = ["".join(map(self.as_bytes.__getitem__, p)) for p in pieces]
            ids = [t.id for p in pieces for t in self.model.tokenize(p)]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: str | None) -> bytes:
        data = (text or "").encode("utf-8", "replace")
        if self.special.search(data):
            ids = self.whole.encode(data.decode("utf-8"), add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(self.chunks.__getitem__, data.lower().split()))  # both ASCII only


@functools.lru_cache(maxsize=1)
def word_bpe(path: str) -> WordBpe:
    """One for each Python worker, so that words are remembered from task to task."""
    return WordBpe(path)
