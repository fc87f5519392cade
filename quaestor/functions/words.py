"""Words of many texts at once, cut from their bytes."""

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quaestor.functions import rules as R

_letters: dict[str, np.ndarray] = {}


def letters(spark: SparkSession) -> np.ndarray:
    """Which code points are part of a term: what the pattern of terms says where it runs otherwise, in Spark."""
    key = spark.sparkContext.applicationId
    if key not in _letters:
        point = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
        points = spark.range(0x110000).where("id < 55296 OR id > 57343").where(point.rlike(f"^{R.TOKEN}$"))
        found = np.zeros(0x110000, bool)
        found[points.toArrow().column("id").to_numpy()] = True
        _letters[key] = found
    return _letters[key]


def _points(data: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """The code points that begin at the places `lead`, each of two to four bytes of UTF-8; 0 where there is none."""
    first, last = data[lead].astype(np.int64), len(data) - 1
    size = 2 + (first >= 0xE0) + (first >= 0xF0)
    point = first & (0x7F >> size)
    good = (first >= 0xC2) & (first <= 0xF4)
    for i in (1, 2, 3):
        more, here = size > i, data[np.minimum(lead + i, last)]
        good &= ~more | ((lead + i <= last) & (here & 0xC0 == 0x80))
        point = np.where(more, point << 6 | here & 0x3F, point)
    return np.where(good & (point < 0x110000), point, 0)


def toks(text: pa.Array, letter: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Number of words of each text, and all words: terms, stop words and the ends of lines.  Texts are bytes in lower case."""
    text = text.cast(pa.binary())
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    end = data == 10
    inside = np.append(letter[:128], np.zeros(128, bool))[data] | end
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        good = letter[_points(data, lead)]
        lead = lead[good]
        size = 2 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
        inside[lead] = True
        for i in (1, 2, 3):
            inside[lead[size > i] + i] = True
    first = np.ones(len(data), bool)
    first[1:] = ~inside[:-1] | end[1:] | end[:-1]
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    first &= inside
    at = np.flatnonzero(first)
    ends = np.append(np.flatnonzero(first[inside]), np.count_nonzero(inside)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(data[inside])])
    return np.diff(np.searchsorted(at, offsets)), words
