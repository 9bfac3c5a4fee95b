"""How processors reach the workers, and how they keep what grows."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark import cloudpickle

import tidemark


@contextlib.contextmanager
def by_value() -> Iterator[None]:
    """While it holds, what is pickled takes the code of this package along.

    The worker that sets up a stream's state sees no files that the session added, so a processor
    must not lean on this package being installed there.
    """
    cloudpickle.register_pickle_by_value(tidemark)
    try:
        yield
    finally:
        cloudpickle.unregister_pickle_by_value(tidemark)


def held(state) -> dict:
    """The entries of a list state whose rows hold keys and values of many (two arrays)."""
    return {k: v for keys, values in state.get() for k, v in zip(keys, values)}


def kept(state, before: dict, now: dict) -> None:
    """Brings a list state that is read by ``held`` from ``before`` to ``now`` in one call and one row.

    Every row of state is packed and unpacked by itself on both sides, which takes longer than what is
    done with it; so what a batch adds is one row of arrays. The last value of a key holds. The list is
    written anew when something is forgotten.
    """
    if before.keys() - now.keys():
        state.put([(list(now), list(now.values()))]) if now else state.clear()
    elif changed := {k: v for k, v in now.items() if k not in before or before[k] != v}:
        state.appendValue((list(changed), list(changed.values())))
