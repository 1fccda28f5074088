"""Texts as arrays of code points, in chunks of bounded size."""

import numpy as np

CHUNK = 1 << 19


def parts(texts, size):
    """(number, part) of the texts in lower case; long ones in parts, cut behind a blank where there is one."""
    for number, text in enumerate(texts):
        text = text.lower()
        start = 0
        while len(text) - start > size:
            end = text.rfind(" ", start + 1, start + size) + 1 or start + size
            yield number, text[start:end]
            start = end
        yield number, text[start:] if start else text


def chunks(texts, size=CHUNK):
    """(numbers, ends, codes): for each part the number of its text and its end in `codes`.

    Texts are taken whole, in lower case, with two blanks behind each part.
    """
    numbers, taken, total = [], [], 0
    for number, part in parts(texts, size):
        if taken and total + len(part) > size:
            yield pack(numbers, taken)
            numbers, taken, total = [], [], 0
        numbers.append(number)
        taken.append(part)
        total += len(part)
    if taken:
        yield pack(numbers, taken)


def pack(numbers, taken):
    codes = np.frombuffer("".join(x + "  " for x in taken).encode("utf-32-le"), "<u4")
    return np.array(numbers), np.cumsum([len(x) + 2 for x in taken]), codes
