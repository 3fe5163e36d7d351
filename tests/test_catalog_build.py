"""The catalogue build over two small lists: every rule that decides which claim prices a model."""

from __future__ import annotations

import json

import pytest

from tidemark.sources import catalog_build as B
from tidemark.sources.catalog import RATES


def own(inp, out, provider="anthropic", mode="chat", **more):
    return {"litellm_provider": provider, "mode": mode, "input_cost_per_token": inp, "output_cost_per_token": out, **more}


FIRST = {
    "sample": {"litellm_provider": "one of ...", "input_cost_per_token": "0.0"},
    "note": "not an entry",
    "claude-big-5": own(4e-06, 2e-05, cache_read_input_token_cost=2e-07, cache_creation_input_token_cost=5e-06, cache_creation_input_token_cost_above_1hr=8e-06),
    "claude-small-9": own(1e-06, 5e-06),
    "gpt-7": own(2e-06, 1e-05, provider="openai", cache_read_input_token_cost=1e-07, input_cost_per_token_above_272k_tokens=4e-06),
    "openai/gpt-8": own(3e-06, 9e-06, provider="openai", mode=None),
    "gpt-picture": own(5e-06, 4e-05, provider="openai", mode="image_generation"),
    "gpt-nothing": own(0, 0, provider="openai"),
    "gpt-9:free": own(1e-06, 1e-06, provider="openai"),
    "azure/gpt-7": own(9e-06, 9e-05, provider="azure"),
    "xai/robo-9": own(2e-06, 6e-06, provider="xai"),
    "xai/draw-9": own(2e-06, 6e-06, provider="xai", mode="image_generation"),
    "claude-dated-1-20250101": own(3e-06, 7e-06),
    "claude-dated-1-20250601": own(3e-06, 7e-06),
    "claude-torn-1-20250101": own(3e-06, 7e-06),
    "claude-torn-1-20250601": own(4e-06, 7e-06),
    "anthropic.claude-old-20240101-v1:0": own(3e-06, 1.5e-05, provider="bedrock", cache_read_input_token_cost=3e-07),
    "vertex_ai/claude-old@20240101": own(8e-06, 8e-05, provider="vertex"),
    "vertex_ai/claude-older@20230101": own(8e-06, 2.4e-05, provider="vertex"),
    "vertex_ai/claude-older@20230601": own(9e-06, 2.4e-05, provider="vertex"),
    "anthropic.claude-small-9-v1:0": own(7e-06, 7e-06, provider="bedrock"),
}
SECOND = {
    "opencode": {"models": {
        "robo-9": {"cost": {"input": 9, "output": 9}}, "draw-9": {"cost": {"input": 9, "output": 9}}, "muse-9": {"cost": {"input": 1.5, "output": 5}}, "muse-9-free": {"cost": {"input": 1, "output": 1}},
        "zen-9": {"cost": {"input": 1, "output": 2, "tiers": [{"x": 1}]}}, "speak-9": {"cost": {"input": 1, "output": 2}, "modalities": {"output": ["audio"]}}, "zero-9": {"cost": {"input": 0, "output": 0}}, "at@1": {"cost": {"input": 1, "output": 1}},
        "claude-dated-1": {}, "claude-torn-1": {},
    }},
    "meta": {"models": {"Muse-9": {"cost": {"input": 1.25, "output": 4.25, "cache_read": 0.15}}}},
    "amazon-bedrock": {"models": {"claude-new-2": {"cost": {"input": 5, "output": 25, "context_over_200k": {"input": 9}}}}},
    "venice": {"models": {"claude-big-5-turbo": {"cost": {"input": 9.6, "output": 48}}, "claude-new-2": {"cost": {"input": 99, "output": 99, "cache_read": 1}}}},
    "broken": "text",
}


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("lists")
    for name, data in (("first", FIRST), ("second", SECOND)):
        (at / f"{name}.json").write_text(json.dumps(data, indent=1))
    return B.build(B.first_list(spark, str(at / "first.json")), B.second_list(spark, str(at / "second.json"))).cache()


def test_claims(built):
    rows = {r.model: r for r in built.collect()}
    rates = lambda m: tuple(rows[m][r] for r in RATES)
    from_ = lambda m: (rows[m].source, rows[m].upstream, rows[m].trust)
    assert len(rows) == built.count() == len(set(rows))
    assert set(rows) == {
        "claude-big-5", "claude-small-9", "gpt-7", "openai/gpt-8", "claude-dated-1-20250101", "claude-dated-1-20250601", "claude-torn-1-20250101", "claude-torn-1-20250601",
        "claude-old", "claude-older-20230101", "claude-older-20230601", "robo-9", "muse-9", "zen-9", "claude-dated-1", "claude-new-2",
    }
    assert rates("claude-big-5") == (4.0, 20.0, 0.2, 5.0, 8.0) and rows["gpt-7"].tiered and not rows["claude-big-5"].tiered
    assert rates("claude-small-9")[4] == 2.0 and rates("gpt-7") == (2.0, 10.0, 0.1, None, None)
    assert rates("claude-old") == (3.0, 15.0, 0.3, None, 6.0) and from_("claude-old") == ("litellm", "anthropic.claude-old-20240101-v1:0", "platform")
    assert rates("claude-older-20230601")[0] == 9.0
    assert from_("robo-9") == ("litellm", "xai/robo-9", None) and rates("robo-9")[:2] == (2.0, 6.0)
    assert from_("muse-9") == ("models.dev", "meta/Muse-9", "owner") and rates("muse-9") == (1.25, 4.25, 0.15, None, None)
    assert from_("zen-9")[2] == "reseller" and rows["zen-9"].tiered
    assert rates("claude-dated-1")[:2] == (3.0, 7.0) and rows["claude-dated-1"].upstream == "claude-dated-1-20250601"
    assert rows["claude-new-2"].trust == "platform" and rates("claude-new-2")[4] is not None


def test_history(spark, built):
    kind = "model string, provider string, effective_from long, " + ", ".join(f"{r} double" for r in RATES)
    previous = spark.createDataFrame([("claude-big-5", "anthropic", 0, 5.0, 25.0, 0.5, 6.25, 10.0), ("claude-big-5", "anthropic", 70, 4.5, 20.0, 0.2, 5.0, 8.0), ("gpt-7", "openai", 50, 2.0, 10.0, 0.1, None, None), ("claude-small-9", "anthropic", 9, 1.0, 5.0, None, None, 2.001), ("gone", "x", 0, 1.0, 1.0, None, None, None)], kind)
    out = B.with_history(built, previous, 1000)
    of = lambda df, m: sorted((r.effective_from, r.input_mtok) for r in df.where(df.model == m).collect())
    assert of(out, "claude-big-5") == [(0, 5.0), (70, 4.5), (1000, 4.0)] and of(out, "gpt-7") == [(50, 2.0)] and of(out, "zen-9") == [(0, 1.0)] and of(out, "gone") == []
    assert of(B.with_history(built, previous, 1000, ("claude-big-5",)), "claude-big-5") == [(0, 4.0)]
    assert sorted(r.model for r in B.changes(previous, built).collect()) == ["claude-big-5"]
    assert sorted(r.model for r in B.changes(previous, built, 0.0001).collect()) == ["claude-big-5", "claude-small-9"]
