"""A SentencePiece model file read as a unigram model: the same pieces, scores no lower than a floor.

The tests compare with the library's own Viterbi search; the shipped model is of
the other kind, so its type field is set anew.  Scores of -1e9 go, as the
library's single-precision sums lose all others beside them.
"""

import struct


def _varint(raw, i):
    x = shift = 0
    while True:
        x |= (raw[i] & 127) << shift
        shift += 7
        i += 1
        if raw[i - 1] < 128:
            return x, i


def _coded(x):
    out = bytearray()
    while x > 127:
        out.append(x & 127 | 128)
        x >>= 7
    return bytes([*out, x])


def _fields(raw):
    i = 0
    while i < len(raw):
        at = i
        tag, i = _varint(raw, i)
        start = i
        if tag & 7 == 0:
            _, i = _varint(raw, i)
        elif tag & 7 == 2:
            n, start = _varint(raw, i)
            i = start + n
        else:
            i += 4 if tag & 7 == 5 else 8
        yield tag, raw[start:i], raw[at:i]


def twin(raw: bytes, floor: float = -50_000.0) -> bytes:
    out = []
    for tag, body, whole in _fields(raw):
        if tag >> 3 == 1:  # a piece: text, score, kind
            parts = []
            for t, b, w in _fields(body):
                if t >> 3 == 2:
                    w = _coded(t) + struct.pack("<f", max(floor, struct.unpack("<f", b)[0]))
                parts.append(w)
            new = b"".join(parts)
            out.append(_coded(tag) + _coded(len(new)) + new)
        elif tag >> 3 == 2:  # how it was trained; field 3 is the kind of model, 1 a unigram model
            new = b"".join(_coded(t) + _coded(1) if t >> 3 == 3 else w for t, b, w in _fields(body))
            out.append(_coded(tag) + _coded(len(new)) + new)
        else:
            out.append(whole)
    return b"".join(out)
