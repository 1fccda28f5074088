"""What Python workers do alike: keep little, and take rows in small portions."""

import numpy as np
import pyarrow.compute as pc

#: Bytes of text that a worker turns into Python objects at once; a longer text is a portion of its own.
PORTION = 4 << 20

_kept = {}


def kept(key, make=dict):
    """The worker's object of that key, made on first use.

    One at a time: workers serve one operator after the other, and what the last one
    kept - tables, remembered pieces - would otherwise stay in memory beside the next one's.
    """
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def portions(batches, column, size=None):
    """The rows of `batches` in portions of about `size` bytes in `column`.

    What a worker makes of a portion goes back to the JVM before the next, so neither holds
    the results of a whole batch.
    """
    for batch in batches:
        bytes_of = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        number = np.cumsum(bytes_of, dtype=np.int64) // (size or PORTION)
        start = 0
        for end in np.flatnonzero(np.diff(number, append=-1)) + 1:
            yield batch.slice(start, end - start)
            start = end
