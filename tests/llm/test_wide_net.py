"""A net of more addresses than one hop reaches."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lumenfold.llm.repeats import Net, read_bundles, remove_repeats


def lone(table):
    return [(row["dest"], row["src"], table.slice(k, 1)) for k, row in enumerate(table.to_pylist())]


@pytest.mark.parametrize(("size", "fan", "hops"), [(40, 32, 2), (64, 8, 2), (65, 8, 3), (30, 32, 1), (1, 8, 1)])
def test_relays_share_the_messages(size, fan, hops):
    """Just beyond a hop's reach, the next hop isn't left to a few tasks, and all messages arrive."""
    net = Net(size, fan)
    assert net.hops == hops and net.fan <= fan
    rows = [row for k in range(size) for row in lone(net.post(1, k, np.arange(size), np.full(size, k), [(b"x",)] * size))]
    for hop in range(2, hops + 1):
        relays = {}
        for dest, src, row in rows:
            relays.setdefault((dest, src // net.fan), []).append(row)
        assert max(len(read_bundles(pa.concat_tables(some))[0]) for some in relays.values()) <= 4 * size
        rows = []
        for (dest, src), some in relays.items():
            table = net._relay(hop, None)((pa.scalar(dest), pa.scalar(src)), pa.concat_tables(some))
            rows += lone(table)
    arrived = Counter()
    for dest, _, row in rows:
        to, sender, _ = read_bundles(row)
        assert set(to.tolist()) == {dest}
        arrived.update((dest, s) for s in sender.tolist())
    assert set(arrived.values()) == {1} and len(arrived) == size * size


def test_kept_text(spark):
    """What is left of a text, without a character that was cut in half."""
    docs = spark.createDataFrame([(1, "a" * 50 + "é"), (2, "<" + "a" * 50 + "è>"), (3, None)], "doc_id long, text string")
    kept = {r["doc_id"]: (r["n_removed"], r["kept"]) for r in remove_repeats(docs, with_text=True).collect()}
    assert kept == {1: (0, "a" * 50 + "é"), 2: (51, "<>"), 3: (0, "")}
