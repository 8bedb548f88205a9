"""Token ids of whole texts, computed once for each distinct chunk of a batch.

Byte-level BPE first splits a text by a pattern and then merges inside each part, so a text may be cut at
any boundary between such parts and its pieces encoded apart. Every blank that stands before a non-blank
begins a part, and so does the end of a run of blanks, and a full stop or the like after a letter: these are
the cuts used here. Each distinct chunk is encoded once by the library and remembered up to a bound. A text
that holds an added token, as <|endoftext|> written out, goes to the library whole, which looks for those first.
"""

from __future__ import annotations

import os
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

from panelkit.llm.shared import kept

#: Unicode's White_Space characters, which the tokenizer's own pattern calls blank. Fixed values.
_BLANK = "\t-\r \x85\xa0  -     　"
_LETTER = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
_MARK = ".,;:!?"
#: A word of letters that ends before a blank or a mark; marks before a blank; any other run of non-blanks;
#: blanks but the last one before a non-blank; other blanks.
_CHUNK = re.compile(f" ?[{_LETTER}]+(?![^{_BLANK}{_MARK}])|[{_MARK}]+(?![^{_BLANK}])| ?[^{_BLANK}]+|[{_BLANK}]+(?=[{_BLANK}][^{_BLANK}])|[{_BLANK}]+")


class Encoder:
    """Encodes batches of texts; keeps ids of the first ``most`` chunks between batches.

    Once they are full, other chunks are encoded where they occur. When those come to ``most`` in turn, the texts
    have changed, and chunks are remembered anew. With ``plain`` the strings of added tokens are ordinary text.
    """

    #: What a text is cut into.
    chunk = _CHUNK

    def __init__(self, path: str, most: int = 500_000, plain: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added and not plain else None
        self.most = most
        self._measure()
        self._forget()

    #: Chunks that are one part each for the library, also behind one another.
    whole = re.compile(f" [{_LETTER}]+")
    between = ""

    def _measure(self) -> None:
        """Bytes of every id: each character of a byte-level token stands for one."""
        n = self.tokenizer.get_vocab_size()
        self.bytes = np.fromiter((len(self.tokenizer.id_to_token(i)) for i in range(n)), np.int64, n)

    def _ends(self, ids: list[int], chunks: list[str]) -> list[int] | None:
        """Where each chunk's ids end among those of all of them behind one another; None if they can't be told apart."""
        at, ends = np.cumsum(self.bytes[ids]), np.cumsum([len(c.encode()) for c in chunks])
        found = np.searchsorted(at, ends)
        return (found + 1).tolist() if len(at) and at[-1] == ends[-1] and (at[found] == ends).all() else None

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The library's ids of each text or chunk.

        A call of the library costs more than a word, so chunks of letters are encoded a few hundred behind one another and told apart afterwards.
        """
        out: list[list[int]] = [[]] * len(texts)
        words = [i for i, t in enumerate(texts) if self.whole.fullmatch(t)]
        groups = [words[k : k + 256] for k in range(0, len(words), 256)]
        rest = sorted(set(range(len(texts))).difference(words))
        for group, ids in zip(groups, self._library([self.between.join([texts[i] for i in g]) for g in groups]), strict=True):
            ends = self._ends(ids, [texts[i] for i in group])
            if ends is None:
                rest += group
                continue
            for i, begin, end in zip(group, [0, *ends], ends, strict=False):
                out[i] = ids[begin:end]
        for i, ids in zip(rest, self._library([texts[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = np.empty(0, np.uint32)
        self.first = np.zeros(1, np.int64)
        self.others = 0

    def _with(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The remembered ids and where each chunk's begin, with those of ``new`` after them."""
        found = self.encode(new)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))])
        first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])
        if len(self.place) + len(new) <= self.most:
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            self.ids, self.first = ids, first
        else:
            self.others += len(new)
            if self.others > self.most:
                self._forget()
        return ids, first

    def __call__(self, texts: list[str | None], group_chars: int = 2 << 20) -> list[np.ndarray]:
        """The ids of each text; null and empty texts have none."""
        out: list[np.ndarray] = []
        i = 0
        while i < len(texts):
            k, size = i, 0
            while k < len(texts) and (k == i or size < group_chars):
                size += len(texts[k] or "")
                k += 1
            out += self._group(texts[i:k])
            i = k
        return out

    def _group(self, texts: list[str | None]) -> list[np.ndarray]:
        whole = [i for i, t in enumerate(texts) if t and self.added and self.added.search(t)]
        if whole:
            found = self._library([texts[i] for i in whole])
            rest = list(texts)
            for i in whole:
                rest[i] = None
            out = self._group(rest)
            for i, ids in zip(whole, found, strict=True):
                out[i] = np.array(ids, np.uint32)
            return out
        chunks = [self.chunk.findall(t) if t else [] for t in texts]
        coded = pa.array(list(chain.from_iterable(chunks)), pa.large_string()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        at = np.fromiter(map(self.place.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(at < 0)
        at[new] = len(self.place) + np.arange(len(new))
        all_ids, first = self._with([distinct[i] for i in new.tolist()]) if len(new) else (self.ids, self.first)
        at = at[coded.indices.to_numpy(zero_copy_only=False)]
        sizes = first[at + 1] - first[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = all_ids[np.repeat(first[at] - ends[:-1], sizes) + np.arange(ends[-1])]
        cuts = ends[np.cumsum([0, *map(len, chunks)])]
        return [ids[x:y] for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


class WordEncoder(Encoder):
    """For vocabularies that drop white space and mark the ends of words: chunks are words between ASCII blanks, without marks at their end."""

    chunk = re.compile(f"[{_LETTER}]+(?![^\x20\x09-\x0D{_MARK}$&*%#])|[{_MARK}$&*%#]+(?![^\x20\x09-\x0D])|[^\x20\x09-\x0D]+")
    whole = re.compile(f"[{_LETTER}]+")
    between = " "
    suffix = "</w>"

    def _measure(self) -> None:
        n = self.tokenizer.get_vocab_size()
        self.last = np.fromiter((self.tokenizer.id_to_token(i).endswith(self.suffix) for i in range(n)), bool, n)

    def _ends(self, ids: list[int], chunks: list[str]) -> list[int] | None:
        ends = (np.flatnonzero(self.last[ids]) + 1).tolist()
        return ends if len(ends) == len(chunks) else None


class PieceEncoder(Encoder):
    """For piece models that put a blank before a text, keep all blanks, and have no piece with a blank behind another character.

    Texts come with that blank before them, and every chunk begins with a blank: the model adds the first one itself.
    A text that holds the model's own sign for a blank goes to the library whole.
    """

    chunk = re.compile(" +[^ ]*")

    def __init__(self, path: str, most: int = 500_000):
        from sentencepiece import SentencePieceProcessor

        self.processor = SentencePieceProcessor(model_file=path)
        self.added, self.most = re.compile("\u2581"), most
        self._forget()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._library(texts)

    def _library(self, texts: list[str]) -> list[list[int]]:
        blank = self.processor.piece_to_id("\u2581")  # the model gives a lone blank before nothing no id
        return [ids or [blank] for ids in self.processor.encode([t[1:] for t in texts], num_threads=1)]


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker, which Spark uses again for its next tasks."""
    return kept(("encoder", path), lambda: Encoder(path))


def word_encoder(path: str) -> Encoder:
    """As ``encoder``, for vocabularies of words."""
    return kept(("word encoder", path), lambda: WordEncoder(path))
