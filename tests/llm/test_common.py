"""The folder that all machines share."""

from types import SimpleNamespace

import pytest

from featlab.llm import common, tokens


def session(master, named=None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: named or default), sparkContext=context)


def test_a_cluster_needs_a_named_folder():
    for master in ("local-cluster[3,2,1024]", "yarn", "spark://host:7077", "k8s://host"):
        assert common.shared_dir(session(master, "hdfs://x/y")) == "hdfs://x/y"
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_dir(session(master))


def test_whole_numbers_never_pass_through_floats():
    frame = common.framed([(2**60 + 1, "a"), (None, None)], ["n", "t"], ("n",))
    assert frame["n"].tolist()[0] == 2**60 + 1 and frame["n"].isna().tolist() == [False, True]
    assert len(common.framed([], ["n", "t"], ("n",))) == 0


def test_a_worker_gives_back_what_it_freed():
    def held():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    def run(batches):
        for n in batches:
            texts = [b"x" * 40_000 for _ in range(n)]  # small enough for the C library to keep
            pin.append(b"y" * 40_000)
            yield len(texts)

    pin = []
    before = held()
    tokens._made["word", "gone"] = object()
    assert list(common.lean(run)(iter([5_000]))) == [5_000]
    assert held() - before < 60_000_000
    assert not tokens._made
