"""What the stream of jobs asks of its store."""

import pandas as pd

from lumenfold.streaming import jobs


class Store(dict):
    """A map state that counts the messages it gets."""

    def __init__(self) -> None:
        super().__init__()
        self.calls = 0

    def _called(self, value):
        self.calls += 1
        return value

    def exists(self):
        return self._called(bool(self))

    def getValue(self, key):
        return self._called(self.get(key))

    def updateValue(self, key, value):
        self[key] = self._called(value)

    def removeKey(self, key):
        del self[self._called(key)]


class Handle:
    def __init__(self) -> None:
        self.maps = {}

    def getMapState(self, name, *_):
        return self.maps.setdefault(name, Store())


def test_few_messages_to_the_store():
    """A hundred jobs of ten scopes that begin and fail leave nothing, and so write nothing; what
    completes is written once, and each scope has its own hashes and jobs."""
    handle = Handle()
    processor = jobs.JobProcessor(1e9, 0.0, False)
    processor.init(handle)
    at = pd.Timestamp("2024-01-01")
    rows = []
    for k in range(100):
        rows += [(f"s{k % 10}", 3 * k, at, f"j{k}", "f", "c", None, None), (f"s{k % 10}", 3 * k + 1, at, f"j{k}", None, None, "security_scan", False)]
    columns = ["scope", "seq", "at", "job_id", "file_sha256", "content_sha256", "stage", "ok"]
    (found,) = processor.handleInputRows((0,), iter([pd.DataFrame(rows[::-1], columns=columns)]), None)
    assert found["status"].tolist().count("failed") == 100 and found["status"].tolist().count("queued") == 100
    assert sum(s.calls for s in handle.maps.values()) == 2 and not any(handle.maps.values())
    rows = [("a", 0, at, "j", "f", "c", None, None), (None, 1, at, "j", "f", "c", None, None), ("a", 2, at, "k", "f", None, None, None)]
    (found,) = processor.handleInputRows((0,), iter([pd.DataFrame(rows, columns=columns)]), None)
    assert sorted(zip(found["seq"], found["status"], strict=True)) == [(0, "queued"), (1, "queued"), (2, "refused")]
    (found,) = processor.handleInputRows((0,), iter([pd.DataFrame([("a", 3, at, "j", None, None, "security_scan", True)], columns=columns)]), None)
    assert found["status"].tolist() == ["running"]
