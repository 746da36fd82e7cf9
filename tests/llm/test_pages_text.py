"""Text of elements that stand in articles, closed or not; Viterbi against every labelling."""

import itertools

import numpy as np
import pytest

from tabloom.llm import pages


def texts(html):
    return [leaf.text for leaf in pages.leaves(html)]


@pytest.mark.parametrize("name", ["button", "select", "svg", "object", "canvas", "audio", "video", "template"])
def test_an_element_without_its_end_tag_loses_nothing(name):
    html = f"<article><h1>T</h1><p>first part</p><{name} class=x>share<p>second part</p><h2>more</h2><p>third</p></article>"
    got = texts(html)
    assert got[:2] == ["T", "first part"] and got[-3:] == ["second part", "more", "third"]
    later = html + f"<footer><{name}>other</{name}></footer>"
    assert "second part" in texts(later) and "third" in texts(later) and not any("other" in t for t in texts(later))


def test_closed_controls_are_no_text():
    assert texts("<p>one <button>share</button> two</p><select><option>a<option>b</select><p>three <svg><text>x</text></svg> four</p>") == ["one", "two", "three four"]
    assert texts("<p>kept</p><script>var x = '<p>no</p>'; more") == ["kept"]


def test_formulas_are_text():
    assert " ".join(texts("<p>Let <math><mi>x</mi><mo>=</mo><mn>3</mn></math> hold</p>")) == "Let x=3 hold"


def test_viterbi_finds_the_best_labelling():
    rng = np.random.default_rng(5)
    for _ in range(40):
        n = int(rng.integers(1, 9))
        steps = rng.normal(size=(2, 2)).tolist()
        score = rng.normal(size=n)
        model = pages.Model({}, steps)
        model.scores = lambda blocks, score=score: score.tolist()
        best = max(itertools.product((0, 1), repeat=n), key=lambda s: sum(score[i] for i in range(n) if s[i]) + sum(steps[s[i]][s[i + 1]] for i in range(n - 1)))
        assert model.decode([None] * n) == list(best)
