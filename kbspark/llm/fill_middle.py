"""Fill-in-the-middle by a piece table.

A batch of texts is one immutable buffer (that of Arrow), the three sentinels are another. A document is a list of
descriptors (buffer, start, end): cutting splits a descriptor, an arrangement permutes descriptors and puts those
of sentinels between them, the inverse permutation restores the text, and digests read the buffers descriptor by descriptor.
No byte is copied before the output itself is written.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The sentinels, and each as (start, end) in their buffer.
SENTINELS = b"<P><S><M>"
P, S, M = (0, 3), (3, 6), (6, 9)
#: What each form puts in a row: a sentinel, then one of the parts 0 (prefix), 1 (middle) and 2 (suffix).
FORMS = {"psm": ((P, 0), (S, 2), (M, 1)), "spm": ((S, 2), (P, 0), (M, 1))}
_SENTINEL = re.compile(b"<[PSM]>")


class PieceTable:
    """A sequence of descriptors over two buffers that never change."""

    def __init__(self, text: memoryview, pieces: list[tuple[memoryview, int, int]]):
        self.text, self.pieces = text, pieces

    @classmethod
    def of(cls, text: memoryview, start: int, end: int) -> PieceTable:
        return cls(text, [(text, start, end)])

    def cut(self, *at: int) -> PieceTable:
        """The last descriptor split at places of the text, in order; a part may be empty."""
        *before, (buffer, start, end) = self.pieces
        ends = [start, *at, end]
        return PieceTable(self.text, [*before, *((buffer, a, b) for a, b in zip(ends, ends[1:]))])

    def arranged(self, form: str) -> PieceTable:
        """Prefix, middle and suffix in the order of a form, each behind its sentinel."""
        out = []
        for sentinel, part in FORMS[form]:
            out += [(memoryview(SENTINELS), *sentinel), self.pieces[part]]
        return PieceTable(self.text, out)

    def restored(self, form: str) -> PieceTable:
        """The inverse of arranged(): the sentinels' descriptors dropped, the others back in the order of the text."""
        parts = self.pieces[1::2]
        place = {part: i for i, (_, part) in enumerate(FORMS[form])}
        return PieceTable(self.text, [parts[place[part]] for part in sorted(place)])

    def write(self) -> bytes:
        return b"".join(buffer[a:b] for buffer, a, b in self.pieces)

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for buffer, a, b in self.pieces:
            digest.update(buffer[a:b])
        return digest.hexdigest()


def _buffers(texts: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of a batch and each text's place in them; a null text is as long as an empty one."""
    _, places, data = texts.buffers()
    wide = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    ends = np.frombuffer(places, wide)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, wide)
    return memoryview(data or b"").cast("B"), ends


def _chars(text: memoryview, start: int, end: int) -> int:
    """Code points: the bytes that go on with none."""
    return int(np.count_nonzero((np.frombuffer(text[start:end], np.uint8) & 0xC0) != 0x80))


_FILLED = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string()), ("output_sha256", pa.string())])
_RESTORED = pa.struct([("text", pa.string()), ("text_sha256", pa.string())])


def fill_in_middle(text: Column, key: Column, salt: str = "7", rate: int = 100, spm: int = 50) -> Column:
    """A struct (n, form, prefix_chars, middle_chars, output, output_sha256) for every row.

    n: the lines `[^\\n]*\\n|[^\\n]+` of the text. Cuts fall between lines, chosen by a SHA-256 of `salt:key` alone, so equal
    rows have equal results wherever they are. form: plain (output is the text) if the text is empty or has a sentinel of its
    own, or for all but `rate` of 100 keys; else spm for `spm` of 100 keys, psm for the others. Null texts count as empty, null
    keys as empty ones. A text that is one line has an empty prefix, middle or suffix, as has any text where
    cuts meet. Lengths count code points and are null for plain rows.
    """

    @F.arrow_udf("n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string")
    def fill(texts: pa.Array, keys: pa.Array) -> pa.Array:
        data, ends = _buffers(texts)
        breaks = np.flatnonzero(np.frombuffer(data, np.uint8)[: int(ends[-1])] == 10)
        first = np.searchsorted(breaks, ends)  # of each text's line ends
        out = []
        for i, k in enumerate(keys.to_pylist()):
            a, b, own = int(ends[i]), int(ends[i + 1]), breaks[first[i] : first[i + 1]]
            n = len(own) + (b > a and data[b - 1] != 10)
            digest = hashlib.sha256(f"{salt}:{'' if k is None else k}".encode()).hexdigest()
            h1, h2, h3, h4 = (int(digest[j : j + 8], 16) for j in (0, 8, 16, 24))
            table = PieceTable.of(data, a, b)
            form = "plain" if a == b or _SENTINEL.search(data, a, b) or h3 % 100 >= rate else "spm" if h4 % 100 < spm else "psm"
            lengths = (None, None)
            if form != "plain":
                place = lambda lines: b if lines > len(own) else int(own[lines - 1]) + 1 if lines else a  # noqa: B023, E731
                low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
                table = table.cut(place(low), place(high))
                lengths = (_chars(*table.pieces[0]), _chars(*table.pieces[1]))
                table = table.arranged(form)
            out.append((n, form, *lengths, table.write(), table.sha256()))
        columns = list(zip(*out)) or [()] * len(_FILLED)
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FILLED)], fields=list(_FILLED))

    return fill(text, key.cast("string"))


def restore(output: Column, form: Column) -> Column:
    """A struct (text, text_sha256): the text that fill_in_middle() made this output from, by the output and its form alone.

    Null output or form: null. A psm or spm output without its three sentinels in their order is an error."""

    @F.arrow_udf("text string, text_sha256 string")
    def back(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        data, ends = _buffers(outputs)
        out = []
        for i, (form, valid) in enumerate(zip(forms.to_pylist(), outputs.is_valid().to_pylist())):
            if form is None or not valid:
                out.append((None, None))
                continue
            table = PieceTable.of(data, int(ends[i]), int(ends[i + 1]))
            if form != "plain":
                at = [m.span() for m in _SENTINEL.finditer(data, int(ends[i]), int(ends[i + 1]))]
                if [data[a:b] for a, b in at] != [SENTINELS[a:b] for (a, b), _ in FORMS[form]] or at[0][0] != int(ends[i]):
                    raise ValueError(f"an output of form {form} must have each of its sentinels once, in order")
                table = table.cut(*(x for span in at for x in span))
                table = PieceTable(data, table.pieces[1:]).restored(form)  # nothing stands before the first sentinel
            out.append((table.write(), table.sha256()))
        columns = list(zip(*out)) or [()] * len(_RESTORED)
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RESTORED)], fields=list(_RESTORED))

    return back(output, form)
