"""Cases in which an operator did less than its whole job."""

import textwrap
from pathlib import Path

import numpy as np
import pytest

from tasklore.llm import licenses, mixing, simhash, topk
from tasklore.llm.common import table

FOLDER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


def test_top_k_of_many_exact_copies(spark):
    """Hundreds of equal bounds in one candidate block: every row is read once and the smallest ids win."""
    rng = np.random.default_rng(5)
    ids = rng.permutation(np.arange(1, 1801))
    common = rng.normal(size=8)
    vectors = {int(vec_id): common if number < 900 else rng.normal(size=8) * 0.4 for number, vec_id in enumerate(ids)}
    rows = [(vec_id, [float(x) for x in vector]) for vec_id, vector in vectors.items()]
    whole = {vec_id: np.floor(np.array(vector, np.float32).astype(np.float64) * 256) for vec_id, vector in vectors.items()}
    wanted = set()
    for query in (vec_id for vec_id in whole if vec_id % 50 == 0):
        scores = sorted((-int(whole[query] @ vector), vec_id) for vec_id, vector in whole.items() if vec_id != query)
        wanted |= {(query, rank, vec_id, -score) for rank, (score, vec_id) in enumerate(scores[:5], 1)}
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted(map(tuple, found)) == sorted(wanted)


@pytest.fixture(scope="module", params=["corpus", "templates alone"])
def license_model(spark, request):
    documents = table(spark, FOLDER, "documents", "doc_id", "text")
    return licenses.fit(documents if request.param == "corpus" else documents.limit(0))


def confirmed(model, text):
    return [family for family, _, yes in model.scan(text) if yes]


@pytest.mark.parametrize("form", ["{}", "# {}", "**{}**", "[{}](https://example.org/x)", "<p>{}</p>", "_{}_"])
def test_license_templates_alone_on_a_line(license_model, form):
    for family, texts in licenses.TEMPLATES.items():
        for text in texts:
            assert confirmed(license_model, "Some words\n" + form.format(text) + "\nother words") == [family], text


@pytest.mark.parametrize("text", ["the of and to in a", "", None, "Please read the license before you use it", "no known gram"])
def test_no_license(license_model, text):
    assert confirmed(license_model, text) == []


@pytest.mark.parametrize("leader", ["", "# ", " * ", "dnl "])
@pytest.mark.parametrize("width", [60, 66, 72, 80])
def test_wrapped_license_templates(license_model, width, leader):
    for family, texts in licenses.TEMPLATES.items():
        for text in texts:
            wrapped = "\n".join(leader + line for line in textwrap.wrap(text, width))
            assert [(found, yes) for found, _, yes in license_model.scan("Title\n" + leader + "\n" + wrapped)] == [(family, True)], text


def test_license_notices_of_neighbouring_lines(license_model):
    text = "Some words\nReleased under the MIT License\nLicensed under CC BY-NC 4.0\n\nSPDX-License-Identifier: MIT\nSPDX-License-Identifier: Apache-2.0\n"
    assert set(confirmed(license_model, text)) == {"MIT", "CC-BY-NC", "Apache"}


def test_near_duplicates_without_ids_stay_once(spark):
    """Exact and near copies that all lack an id leave one row; those of a document with an id leave none."""
    long = " ".join(f"w{number}" for number in range(400))
    texts = [long] * 4 + [long + " tail"] * 3 + ["other words in another text"] * 3 + ["a document with an id"] * 2
    rows = [(None, text, f"s{number}") for number, text in enumerate(texts)] + [(7, "a document with an id", "s"), (8, "alone", "s")]
    prints = [simhash.fingerprint(text) for text in (long, long + " tail")]
    assert (prints[0] ^ prints[1]).bit_count() <= 3
    kept = [[(row.doc_id, row.text, row.source) for row in simhash.keep_one_of_each(frame).collect()] for frame in (
        spark.createDataFrame(part, "doc_id long, text string, source string").repartition(3) for part in (rows, rows[::-1]))]
    assert sorted(kept[0], key=str) == sorted(kept[1], key=str)
    assert sorted(doc_id for doc_id, _, _ in kept[0] if doc_id) == [7, 8]
    assert sorted(text.startswith("w0") for doc_id, text, _ in kept[0] if doc_id is None) == [False, True]


def test_mixture_of_rows_without_ids(spark):
    """Each row without id has a coin of its own, so its source meets its target."""
    rows = [(None, f"text number{number}", f"s{number % 3}") for number in range(6000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mixture(frame).groupBy("target").agg({"taken": "sum"}).collect()
    assert found and all(row["sum(taken)"] == pytest.approx(row.target, rel=0.08) for row in found)
    assert 2 * mixing.mix(frame).count() == sum(row["sum(taken)"] for row in found)
