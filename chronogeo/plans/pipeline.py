"""A pipeline of steps declared in YAML, bound to one lazy plan.

The text is a list of groups, each with a name and steps. A step names its
inputs in ``dependsOn``: a group's name means its last step, ``group.STEP``
means that step. Every step after a group's first also gets ``in`` from the
one before it. Other entries of a step are its parameters.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from typing import Any

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronogeo.plans.steps import SLICED, STEPS, Context, run_step
from chronogeo.session import durable_table


class PipelineError(ValueError):
    pass


@dataclass
class Node:
    group: str
    step: str
    inputs: dict[str, str] = field(default_factory=dict)
    parameters: dict[str, Any] = field(default_factory=dict)


def parse(text: str) -> dict[str, Node]:
    """Nodes by id (group.STEP, with _n where a step repeats in a group), with resolved inputs."""
    groups = yaml.safe_load(text) or []
    nodes: dict[str, Node] = {}
    last: dict[str, str] = {}
    for g in groups:
        before = None
        for s in g["steps"]:
            name = s["step"]
            if name not in STEPS:
                raise PipelineError(f"unknown step {name}")
            key, n = f"{g['name']}.{name}", 1
            while key in nodes:
                n += 1
                key = f"{g['name']}.{name}_{n}"
            inputs = dict(s.get("dependsOn") or {})
            if before and "in" not in inputs:
                inputs = {"in": before} | inputs
            nodes[key] = Node(g["name"], name, inputs, {k: v for k, v in s.items() if k not in ("step", "dependsOn")})
            before = last[g["name"]] = key
    for key, node in nodes.items():
        for name, source in node.inputs.items():
            found = source if source in nodes else last.get(source)
            if found is None:
                raise PipelineError(f"{key}: no step {source}")
            node.inputs[name] = found
    return nodes


def ordered(nodes: dict[str, Node]) -> list[str]:
    """Ids with inputs first; a cycle is an error."""
    out: list[str] = []
    state: dict[str, int] = {}

    def visit(key: str) -> None:
        if state.get(key) == 1:
            raise PipelineError(f"{key} depends on itself")
        if key not in state:
            state[key] = 1
            for source in nodes[key].inputs.values():
                visit(source)
            state[key] = 2
            out.append(key)

    for key in nodes:
        visit(key)
    return out


def runtimes(ctx: Context, text: str) -> DataFrame:
    """step, id, seconds of the steps that have run, most first; a step that isn't written took only its planning."""
    nodes = parse(text)
    return ctx.spark.createDataFrame([(nodes[k].step, k, s) for k, s in ctx.seconds.items()], "step string, id string, seconds double").orderBy(F.desc("seconds"))


def run(ctx: Context, text: str, only: list[str] | None = None) -> dict[str, DataFrame]:
    """Results of all steps (or of those needed for some) by id.

    Results of geometric steps, and what several steps read, are written to the shared checkpoint folder and read
    from there: each is computed once, plans stay small, and lost executors cost no more than one step.
    """
    nodes = parse(text)
    order = ordered(nodes)
    if only:
        needed = set()

        def need(key: str) -> None:
            if key not in needed:
                needed.add(key)
                for source in nodes[key].inputs.values():
                    need(source)

        for key in only:
            need(key)
        order = [k for k in order if k in needed]
    readers: dict[str, int] = {}
    for key in order:
        for source in nodes[key].inputs.values():
            readers[source] = readers.get(source, 0) + 1
    out: dict[str, DataFrame] = {}
    for key in order:
        node, began = nodes[key], time.perf_counter()
        result = run_step(ctx, node.step, {k: out[s] for k, s in node.inputs.items()}, **node.parameters)
        keep = result is not None and (STEPS[node.step].needs == SLICED or readers.get(key, 0) > 1)
        out[key] = durable_table(result) if keep else result
        ctx.seconds[key] = time.perf_counter() - began
    return out
