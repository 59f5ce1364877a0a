"""What a Python worker keeps between tasks: one operator's things at a time, so that stages that share workers don't
pile up what each has learned, and no more than LIMIT bytes of learned words."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa

#: Bytes that a Memo may take, and what a place in it costs beside its key and value.
LIMIT, SLOT = 40 << 20, 100

_held: dict[Any, Any] = {}
_owner: list[str] = [""]


class Memo(dict):
    """What has been learned, by key. Once LIMIT bytes are taken, nothing is added: results are the same, at more work."""

    def __init__(self, limit: int = LIMIT):
        super().__init__()
        self.left = limit

    def learn(self, new: dict) -> None:
        if self.left > 0:
            for k, v in new.items():
                self.left -= SLOT + sys.getsizeof(k) + sys.getsizeof(v)
                if self.left <= 0:
                    break
                self[k] = v


def release() -> None:
    """Gives freed memory back to the system; after a batch of texts that is some tens of MB."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def only(owner: str) -> None:
    """From here on the worker belongs to this operator; what others kept is dropped."""
    if _owner[0] != owner:
        _held.clear()
        _owner[0] = owner
        gc.collect()
        release()


def trimmed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; once the next is asked for, what the last one took is given back."""
    for b in batches:
        yield b
        del b
        release()


def kept(owner: str, key: Any, make: Callable[[], Any]) -> Any:
    """The thing kept under a key, made if it isn't there."""
    only(owner)
    if key not in _held:
        _held[key] = make()
    return _held[key]
