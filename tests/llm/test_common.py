import os

from tidings.llm.common import released


def held_mb():
    with open("/proc/self/statm") as file:
        return int(file.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20


def test_a_task_gives_its_memory_back():
    kept = []

    def run(batches):
        for batch in batches:
            pieces = [bytes([1]) * 100_000 for _ in range(3000)]
            # What lives on above the pieces keeps the heap from shrinking by itself.
            kept.append(bytes([2]) * 100_000)
            yield batch * len(pieces[0])

    before = held_mb()
    assert list(released(run)(iter([1, 2]))) == [100_000, 200_000]
    assert held_mb() < before + 100
