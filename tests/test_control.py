"""The control loop with replayed models."""

import json

import numpy as np
import pytest

from tessera.control import bandit, budget, model, prefix, search
from tessera.plans.sqltool import Environment


def test_metering():
    b = budget.Budget()
    assert b.record_execution(3600) == pytest.approx(0.05)
    b.record(10, 0.10)
    assert b.spent == pytest.approx(0.15) and not b.exhausted and budget.Budget(dollars=0.1, level=1, spent=0.2).exhausted
    assert [budget.task_level(x) for x in (1, 2, 3, None, 4, "weird", "M2")] == [1, 2, 3, 1, 1, 1, 2]


def test_bandit_learns_the_better_arm():
    b = bandit.FactoredLinUCB(2, 3)
    arms = [[1, 0, 1], [0, 1, 1]]
    for _ in range(250):
        b.update([1, 0], arms[0], 0.1)
        b.update([1, 0], arms[1], 0.9)
    assert b.rank([1, 0], arms)[0][0] == 1
    assert np.allclose(b.inverse @ b.a, np.eye(len(b.b)), atol=1e-6)
    assert bandit.plausible_winners([(0, 1.0, 0.1), (1, 0.2, 0.1)]) == 1 and sum(bandit.softmax([1, 2, 3])) == pytest.approx(1)


def test_prefix_cache():
    cache = prefix.PrefixCache(most=4)
    node = cache.register("e", [{"t": "list"}, {"t": "schema"}], ["k1", "k2"])
    cache.reward(node, 1.0)
    assert cache.find("e") == [{"t": "list"}, {"t": "schema"}] and cache.find("other") == []
    for i in range(6):
        cache.register("e", [{"i": i}], [f"x{i}"])
    assert cache.stats()["nodes"] <= 5 and cache.stats()["hit_rate"] == 0.5


def test_replies():
    assert model.answer_text('<think>x</think>```json\n{"answer": "EU 5"}\n```') == "EU 5" and model.answer_text("42") == "42"
    assert model.answer_text('The answer is 5. {"tool_name": "execute_sql"}') == "The answer is 5."
    assert model.tool_call('text {"tool_name": "execute_sql", "arguments": {"query": "SELECT 1"}} more') == ("execute_sql", {"query": "SELECT 1"})
    assert model.first_string('{"answer": "broken', ("answer",)) == "broken"


class Scripted:
    """A model that answers by the operator it is asked for."""

    def call(self, messages, tier="small", max_tokens=0):
        operator = messages[0]["content"].split(";")[0].split()[-1]
        calls = {"discover": ("list_tables", {}), "inspect": ("get_table_schema", {"name": "t"}), "answer": None}
        call = calls.get(operator, ("execute_sql", {"query": "SELECT count(*) AS n FROM t"}))
        return model.Reply("the count is 5" if call is None else json.dumps({"tool_name": call[0], "arguments": call[1]}), 10, 0.001)


@pytest.mark.parametrize("name", list(search.STRATEGIES))
def test_strategies_reach_the_answer(spark, name):
    env = Environment(spark, {"t": spark.range(5).toDF("id")})
    tools = {"list_tables": env.list_tables, "get_table_schema": env.table_schema, "execute_sql": lambda query: env.execute_sql(query)}
    runner = search.Runner(Scripted(), tools, budget.Budget())
    state = search.STRATEGIES[name](runner, "how many rows?", lambda s: 1.0 if s.answer and "5" in s.answer else 0.1 * len(s.steps))
    assert state.answer == "the count is 5" and any("5" in s.output for s in state.data_steps())


def test_no_reply_fails_closed():
    runner = search.Runner(model.Replay(), {}, budget.Budget())
    assert search.react(runner, "q", lambda s: 0.0).answer is None


class Phraser:
    """Picks a frame, and guesses badly."""

    def call(self, messages, tier="small", max_tokens=0):
        return model.Reply('{"frame_id": "risk_review"}' if "Frames:" in messages[0]["content"] else "I would say -77")


def test_synthesis(spark):
    from tessera.control import synthesis
    from tessera.operators.graph import Unit

    make = lambda: {
        "orders": Unit("orders", spark.createDataFrame([("NA", 10), ("EU", 20), ("NA", 30), ("APAC", 5), ("NA", 2)], "region string, revenue long"), "orders"),
        "marketing": Unit("marketing", spark.createDataFrame([("NA", 7), ("EU", 9), ("EU", 4)], "region string, spend long"), "marketing"),
    }
    tasks, tally = synthesis.synthesise(spark, "demo", make(), Phraser(), count=2)
    assert tasks and tally["admitted"] == len(tasks)
    assert all(t.answer_key_rows and t.question.startswith("For the risk team, report") for t in tasks)
    assert not any(str(int(r["value"])) in t.question for t in tasks for r in t.answer_key_rows if r["value"])
    none, tally = synthesis.synthesise(spark, "demo", make(), model.Replay(), count=2)
    assert not none and tally["declined"]
    done = synthesis.run_tasks([t.record() for t in tasks], lambda t, level: {"success": True, "level": level}, finished={tasks[0].task_id})
    assert len(done) == len(tasks) - 1


def test_export(spark):
    from tessera.operators.export import assemble

    t = spark.createDataFrame([(1, "q", "EU 5", 0.9, "{}"), (2, "q", "Analysis completed with 3 steps.", 0.9, "{}"), (3, "q", "x", 0.1, "{}")], "traj_id long, question string, answer string, quality double, certificate string")
    s = spark.createDataFrame([(1, 0, "list_tables", "{}", "a", "/data/x/y/z/t.csv"), (1, 1, "list_tables", "{}", "b", "t"), (1, 2, "execute_sql", "{}", "c", "5"), (1, 3, "execute_sql", "{}", "d", "5"), (2, 0, "list_tables", "{}", "a", "t")], "traj_id long, step_idx int, tool string, arguments string, thought string, output string")
    got = assemble(t, s).collect()
    assert [r["traj_id"] for r in got] == [1]
    messages = got[0]["sample"]["messages"]
    assert [m["role"] for m in messages] == ["user", *["assistant", "tool"] * 3, "assistant"] and "/data" not in messages[2]["content"] and json.loads(messages[2]["content"])["success"]
