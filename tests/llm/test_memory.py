"""What a task's function leaves in its Python worker."""

import sys

import psutil
import pytest

from spindex.llm.common import freeing


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="glibc")
def test_a_task_hands_freed_small_objects_back():
    kept = []

    def each(batches):
        held = []
        for _ in batches:
            held += [bytes(2000) for _ in range(40_000)]
        kept.append(bytes(2000))  # lies above them in the heap
        yield len(held)
        used.append(psutil.Process().memory_info().rss)

    used = []
    assert list(freeing(each)(range(3))) == [120_000]
    assert psutil.Process().memory_info().rss < used[0] - 150e6
