"""Command line over the operators: tables in, tables out (``;``-separated folders with headers).

``python -m odweave.cli <command> INPUT.. OUTPUT [options]``; ``--help`` lists the commands.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odweave.operators import calibrate, flows, measures, privacy, regions, settlement, transfer, windows
from odweave.sources import tables

COMMANDS: dict[str, tuple[Callable, tuple[str, ...], dict]] = {}


def command(name: str, inputs: tuple[str, ...], **options):
    def add(f: Callable) -> Callable:
        COMMANDS[name] = (f, inputs, options)
        return f

    return add


def _flows(df: DataFrame, o: argparse.Namespace) -> DataFrame:
    return flows.interactions(df, o.from_id, o.to_id, o.strength)


def _units(df: DataFrame, o: argparse.Namespace) -> DataFrame:
    return df.withColumnsRenamed({o.unit_id: "id", o.region: "region", o.core: "is_core"})


FLOW = {"from_id": "from_id", "to_id": "to_id", "strength": "strength"}
UNIT = {"unit_id": "id", "region": "region", "core": "is_core"}


@command("anchors-to-flows", ("anchors",), user_id="user_id", site_id="site_id", importance="strength", type="type", multi_home=0.5, exclude_self=False)
def anchors_to_flows(anchors, o):
    named = anchors.select(F.col(o.user_id).alias("user_id"), F.col(o.site_id).alias("site_id"), F.col(o.importance).alias("importance"), F.coalesce(o.type, F.lit("")).alias("type"))
    return flows.from_anchors(named, flows.default_generators(multi_home=o.multi_home, selfinter=not o.exclude_self))


@command("flow-indices", ("flows",), **FLOW)
def flow_indices(df, o):
    return flows.both_directions(_flows(df, o), o.strength)


@command("add-distances", ("flows", "places"), x="X", y="Y", factor=1.0, **FLOW)
def add_distances(df, places, o):
    return flows.add_distances(_flows(df, o), places, o.x, o.y, o.factor)


@command("flow-lines", ("flows", "places"), x="X", y="Y", **FLOW)
def flow_lines(df, places, o):
    return flows.to_lines(_flows(df, o), places, o.x, o.y)


@command("unit-flows", ("flows", "units"), **FLOW, **UNIT)
def unit_flows(df, units, o):
    return flows.unit_flow_summary(_flows(df, o), _units(units, o), o.strength)


@command("multicores", ("flows",), minimum=1.0, **FLOW)
def multicores(df, o):
    return flows.multicores(_flows(df, o), o.minimum, strength=o.strength)


@command("transfer-flows", ("flows", "transfer"), intraflow_eta=False, **FLOW)
def transfer_flows(df, table, o):
    f = _flows(df, o)
    return transfer.transfer_interactions(f, table, [o.strength], transfer.eta_of_intraflows(f, o.strength) if o.intraflow_eta else None)


@command("transfer-static", ("values", "transfer"), id="id", fields="")
def transfer_static(df, table, o):
    return transfer.transfer_static(df, table, o.id, o.fields.split(","))


@command("calibrate-flows", ("flows", "truth"), methods="source,dirstat,ipf", **FLOW)
def calibrate_flows(df, truth, o):
    return calibrate.calibrate_all(_flows(df, o), _flows(truth, o), o.strength, tuple(o.methods.split(",")))


@command("calibrate", ("values",), x="x", y="y", method="ols")
def calibrate_values(df, o):
    return calibrate.calibrated(df, o.x, o.y, o.method)


@command("errors", ("model", "truth"), keys="id", field="value")
def errors(model, truth, o):
    return calibrate.error_metrics(model, truth, o.keys.split(","), o.field)


@command("measure-regions", ("units", "flows"), size="mass", props="mass", only="", exclude="", **FLOW, **UNIT)
def measure_regions(units, df, o):
    return measures.calculate(_units(units, o), _flows(df, o), o.size, o.props.split(","), only=o.only or None, exclude=o.exclude or None)


@command("delimit-regions", ("units", "flows"), criteria="sourceflow_sum", minimums="0", source_core=False, target_core=False, dissolve=False, **FLOW, **UNIT)
def delimit_regions(units, df, o):
    names = o.criteria.split(",")
    u = units.withColumnRenamed(o.unit_id, "id")
    least = dict(zip(names, map(float, o.minimums.split(",")), strict=True))
    return regions.stepwise(regions.initial_state(u), u, _flows(df, o), names, least, o.source_core, o.target_core, o.dissolve, o.strength)


@command("build-system", ("flows",), builder="maxflow", criterion="stagestate", seed=1, **FLOW)
def build_system(df, o):
    return settlement.build_model(_flows(df, o), o.builder, o.strength, o.seed, o.criterion)


@command("system-regions", ("model",), minimum=0.0)
def system_regions(model, o):
    return settlement.regions_by_weight(model, model.select("id", "weight"), o.minimum)


@command("anonymise", ("flows",), epsilon=0.5, seed=1, **FLOW)
def anonymise(df, o):
    return privacy.atomic(_flows(df, o), [o.strength], o.epsilon, o.seed)


@command("zipf-gaps", ("values",), value="value", exponent=-1.0, spread=5)
def zipf_gaps(df, o):
    return windows.zipf_gaps(df, o.value, o.exponent, o.spread)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="odweave", description=__doc__)
    subs = top.add_subparsers(dest="command", required=True)
    for name, (_, inputs, options) in COMMANDS.items():
        sub = subs.add_parser(name)
        for i in (*inputs, "output"):
            sub.add_argument(i)
        sub.add_argument("--sep", default=";")
        for key, default in options.items():
            flag = f"--{key.replace('_', '-')}"
            if isinstance(default, bool):
                sub.add_argument(flag, action="store_true")
            else:
                sub.add_argument(flag, type=type(default), default=default)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    o = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("odweave").getOrCreate()
    run, inputs, _ = COMMANDS[o.command]
    out = run(*[tables.read_csv(spark, getattr(o, i), sep=o.sep) for i in inputs], o)
    tables.write_csv(out, o.output, o.sep)


if __name__ == "__main__":
    main()
