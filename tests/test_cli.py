"""Settings and experiments on the small hypergraph file."""

import pytest

from edgeweft import cli


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("data")
    (at / "a.hg").write_text("1 2 3\n2 3 4\n3 4 5\n4 5 6\n6 7\n8 9\n8 9 10\n11")
    (at / "a_labels").write_text("".join(f"{i}\t{'red' if i % 2 else 'blue'}\n" for i in range(8)))
    return at


def test_parse():
    x = cli.parse(["MAXS=3", "dataFile=b.hg", "isApproximate=true", "alpha=0.2"])
    assert (x.maxS, x.name, x.isApproximate, x.alpha) == (3, "b", True, 0.2)
    for wrong in (["what=1"], ["maxS"], ["kind=other"]):
        with pytest.raises(ValueError):
            cli.parse(wrong)


@pytest.mark.parametrize("experiment,extra", [("profiles", []), ("topk", ["k=2", "isApproximate=true"]), ("line-graph", []), ("indexes", ["width=2", "maxS=2", "landmarkAssignment=prob"])])
def test_experiments(spark, folder, experiment, extra):
    args = [f"experiment={experiment}", f"dataFolder={folder}", f"outputFolder={folder}/out-{experiment}", "dataFile=a.hg", "numQueries=6", "numLandmarks=3", "lb=2", *extra]
    assert cli.run_experiment(spark, cli.parse(args)).count() > 0
