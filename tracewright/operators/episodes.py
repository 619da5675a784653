"""Episodes: a policy acts step by step on a world and is rewarded; conversations are several turns on one world."""

from __future__ import annotations

import re
from collections.abc import Callable
from contextlib import closing
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.fixed import ERROR_HEAD
from .worlds import SqlCheck, SqliteWorld, judged_rows

MOST_SHOWN = 4000
#: Shares of checks on the end state, and of acting at all, in the final reward; penalties on the way.
OUTCOME, GROUNDED, INVALID, ERROR = 0.6, 0.4, 0.1, 0.05


@dataclass
class Episode:
    """One episode on a world: ``act`` until it is done."""

    scenario: dict[str, Any]
    steps: list[tuple[str, str]] = field(default_factory=list)
    rewards: list[float] = field(default_factory=list)
    done: bool = False
    outcome: float = 0.0
    answer: str = ""

    def __post_init__(self) -> None:
        env = self.scenario["environment"]
        self.world = SqliteWorld(env["schema"], env.get("rows"), env.get("table"), env.get("read_only", False))

    def act(self, action: dict[str, Any]) -> str:
        """A query or an answer; what the agent sees. The last allowed step ends the episode and takes its reward along."""
        if self.done:
            raise RuntimeError("the episode is over")
        if action.get("answer") is not None:
            return self.finish(action["answer"], 0.0)
        if "query" not in action:
            seen, reward = "InvalidAction: a query or an answer is needed", -INVALID
        else:
            seen = self.world.execute(action["query"])
            seen = seen if len(seen) <= MOST_SHOWN else seen[: MOST_SHOWN - 1].rstrip() + "…"
            reward = -ERROR if re.match(ERROR_HEAD, seen) else 0.0
            self.steps.append((action["query"], seen))
        self.taken = getattr(self, "taken", 0) + 1
        if self.taken >= self.scenario.get("max_steps", 8):
            self.finish("", reward)
        else:
            self.rewards.append(reward)
        return seen

    def finish(self, answer: str, reward: float) -> str:
        checks = self.scenario.get("checkers") or []
        good = 0
        for c in checks:
            if c.get("kind", "sql") == "sql":
                try:
                    good += judged_rows(SqlCheck(c.get("name", ""), c["query"], c.get("equals"), c.get("contains"), c.get("non_empty")), self.world.rows(c["query"]))
                except Exception:  # noqa: BLE001  a broken check is a failed check
                    pass
            else:
                good += any(x.lower() in answer.lower() for x in c["any_of"])
        self.outcome, self.answer, self.done = round(good / len(checks), 6) if checks else 1.0, answer, True
        self.rewards.append(reward + OUTCOME * self.outcome + GROUNDED * bool(self.steps))
        return f"Episode finished: {answer or '(no answer)'}"

    def transcript(self, most: int = MOST_SHOWN) -> str:
        return "\n".join(f"call {q}\n-> {seen}" for q, seen in self.steps)[-most:]

    def close(self) -> None:
        self.world.close()


Policy = Callable[[str, Episode], dict[str, Any]]


def rollout(policy: Policy, scenario: dict[str, Any]) -> dict[str, Any]:
    """One whole episode of a policy."""
    with closing(Episode(scenario)) as episode:
        seen = scenario["task"]
        while not episode.done:
            seen = episode.act(policy(seen, episode))
        return {"scenario_id": scenario["id"], "passed": episode.outcome >= 1.0, "outcome": episode.outcome, "reward": round(sum(episode.rewards), 6), "steps": len(episode.steps), "answer": episode.answer}


def conversation(policy: Policy, scenario: dict[str, Any], messages: list[str]) -> dict[str, Any]:
    """Several user messages on one world that stays; the checks run once at the end."""
    with closing(Episode({**scenario, "max_steps": 10**6})) as episode:
        replies = []
        for message in messages:
            seen = message
            while True:
                action = policy(seen, episode)
                if action.get("answer") is not None:
                    replies.append(action["answer"])
                    break
                seen = episode.act(action)
        episode.finish(replies[-1] if replies else "", 0.0)
        return {"scenario_id": scenario["id"], "passed": episode.outcome >= 1.0, "outcome": episode.outcome, "turns": len(messages), "replies": replies}


def collected(scenarios: DataFrame, policy: Policy, decode: Callable[[str], dict]) -> DataFrame:
    """Rollouts of rows ``ord, scenario`` (JSON) by a picklable policy, in one world per row."""
    schema = "ord long, scenario_id string, passed boolean, outcome double, reward double, steps int, answer string"

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([{"ord": o, **rollout(policy, decode(s))} for o, s in zip(pdf["ord"], pdf["scenario"], strict=True)], columns=[c.split()[0] for c in schema.split(", ")])

    return scenarios.select("ord", "scenario").mapInPandas(run, schema)
