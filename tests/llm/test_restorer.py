"""Disguises that the restorer must read, and its decoding against enumeration."""

import itertools
import random
import tracemalloc

import numpy as np
import pytest

from wardwatch.llm import toxicity

TEXT = "the ass and the piss and a kiss from hell the silly idiot is stupid and the finger of a stupid idiot pissed the class off " * 20


@pytest.fixture(scope="module")
def restorer(spark):
    return toxicity.Restorer(toxicity.character_model(spark.createDataFrame([(TEXT,)], "text string")))


def test_spots(restorer):
    for spot, word in (
        ("1d107", "idiot"), ("5h17", None), ("a$$", "ass"), ("a55", "ass"), ("a$$!", "ass"), ("(a$$", "ass"), ("p1$$", "piss"), ("k1$$", "kiss"), ("h3||", "hell"), ("idio*", "idiot"),
        ("f****r", "finger"), ("stuupid", "stupid"), ("ssttuuppiidd", "stupid"), ("s  t  u  p  i  d", "stupid"), ("s/t/u/p/i/d", "stupid"), ("s, t, u, p, i, d", "stupid"), ("@$$", "ass"), ("stu.pid", "stupid"),
        ("you/a$$", "ass"), ("s**pid", "stupid"),
    ):
        found = restorer.words(f"You {spot} there")
        if word:
            assert word in found, (spot, found)
        else:
            assert "5h17" in toxicity.spots(f"you {spot} there", set())


def _cost(restorer, spot, outs):
    total, a, b = 0.0, 0, 0
    for i, out in enumerate(outs):
        total += dict(restorer._options(spot, i))[out]
        if out is not None and not (out == " " and b == 0):
            c = toxicity._class_of(out)
            total, a, b = total + restorer.costs[a, b, c], b, c
    return total + restorer.costs[a, b, 0]


def _said(outs):
    said = ""
    for out in outs:
        if out is not None and not (out == " " and said[-1:] in ("", " ")):
            said += out
    return said


@pytest.mark.parametrize("spot", ["s**p1d", "**5", "a$$", "stuu1d", "1**!", "x*-*y"])
def test_reads_the_cheapest_of_all(spot):
    rng = np.random.default_rng(7)
    restorer = toxicity.Restorer(rng.gamma(2.0, 1.5, (toxicity.CLASSES,) * 3))
    ways = itertools.product(*[[o for o, _ in restorer._options(spot, i)] for i in range(len(spot))])
    assert restorer.read(spot) == _said(min(ways, key=lambda outs: _cost(restorer, spot, outs)))


def test_long_runs_take_linear_time():
    for run in ("a" * 200_000, "1" * 200_000, "a " * 100_000, "a." * 100_000, "((" * 100_000):
        toxicity.spots(run, set())


@pytest.mark.parametrize("segment", [1, 3, 7])
def test_segments_read_like_one(monkeypatch, segment):
    rng = random.Random(segment)
    spots = ["".join(rng.choices("ab*1$-!*", k=rng.randint(1, 24))) for _ in range(60)] + ["a" + "*" * 40 + "b**c", "*" * 30, "b" * 20, ""]
    costs = np.random.default_rng(7).gamma(2.0, 1.5, (toxicity.CLASSES,) * 3)
    whole = [toxicity.Restorer(costs).read(x) for x in spots]
    monkeypatch.setattr(toxicity, "SEGMENT", segment)
    assert [toxicity.Restorer(costs).read(x) for x in spots] == whole


def test_runs_read_like_single_steps(restorer, monkeypatch):
    """Steps that are taken at once within a run give what each of them gives."""
    spots = ["*" * n for n in (3, 17, 60)] + ["stu" + "*" * 50 + "pid", "a" + "*" * 33 + "1d"]
    fast = [toxicity.Restorer(restorer.costs).read(x) for x in spots]
    monkeypatch.setattr(toxicity.np, "ptp", lambda x: 1.0)
    assert [toxicity.Restorer(restorer.costs).read(x) for x in spots] == fast


@pytest.mark.parametrize("spot", ["*" * 200_000, "a*" * 4_000, "1" * 20_000, "a-" * 20_000])
def test_long_spots_take_little_memory(restorer, spot):
    tracemalloc.start()
    toxicity.Restorer(restorer.costs).read(spot)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6
