"""Fleet observation: service state and process inventory from per-host snapshots.

``procs`` is ``(host, pid, name)`` (as from a process listing), ``sockets`` is ``(host, pid, port)``
(as from a listening-socket listing). Ports and pids are compared by equality -- 9083 does not
match 19083 and pid 123 does not match 1234.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEALTH_STATES = ("running", "no_listener", "absent")


def _services_array(services):
    """Literal ``array<struct<service, pattern, port>>`` from ``[(service, pattern, port), ...]``."""
    return F.array(*[F.struct(F.lit(s).alias("service"), F.lit(p.lower()).alias("pattern"),
                              F.lit(int(port)).alias("port")) for s, p, port in services])


def service_health(procs: DataFrame, sockets: DataFrame, services, hosts: DataFrame | None = None) -> DataFrame:
    """Per host and service: ``running`` (a matching process owns the expected port),
    ``no_listener`` (a matching process, no such listener), ``absent`` (no matching process).

    A process matches a service when its name contains the service's pattern, ignoring case.
    ``services`` is a short list ``[(service, pattern, port)]`` held as a literal array: matching is a
    filter inside each process row, the listener check is one equi join on ``(host, pid, port)``,
    and one aggregation per host (combined map-side) keeps two flags per service. Hosts default
    to those in ``procs``; pass ``hosts`` to also list hosts without processes.
    """
    services = list(services)
    svc = _services_array(services)
    matched = procs.select("host", "pid", F.explode_outer(F.filter(
        svc, lambda s: F.lower(F.col("name")).contains(s["pattern"]))).alias("s"))
    matched = matched.select("host", "pid", F.col("s.service").alias("service"), F.col("s.port").alias("port"))
    listening = sockets.select("host", "pid", "port").distinct().withColumn("__listen", F.lit(True))
    probe = matched.join(listening, on=["host", "pid", "port"], how="left")
    aggs = []
    for i, (name, _, _) in enumerate(services):
        hit = F.col("service") == F.lit(name)
        aggs += [F.max(hit).alias(f"__has{i}"), F.max(hit & F.col("__listen").isNotNull()).alias(f"__run{i}")]
    per = probe.groupBy("host").agg(*aggs)
    if hosts is not None:
        per = hosts.select("host").distinct().join(per, on="host", how="left")
    states = [F.struct(F.lit(name).alias("service"),
                       F.when(F.col(f"__run{i}"), F.lit("running"))
                       .when(F.col(f"__has{i}"), F.lit("no_listener"))
                       .otherwise(F.lit("absent")).alias("state"))
              for i, (name, _, _) in enumerate(services)]
    return per.select("host", F.inline(F.array(*states)))


def process_inventory(hosts: DataFrame, procs: DataFrame) -> DataFrame:
    """Per host, the number of processes and their sorted distinct names; hosts with none are listed.

    Processes are aggregated per host first (combined map-side), then joined to the host list.
    """
    per = procs.groupBy("host").agg(F.count(F.lit(1)).alias("n_procs"),
                                    F.array_sort(F.collect_set("name")).alias("names"))
    out = hosts.select("host").distinct().join(per, on="host", how="left")
    return out.select("host", F.coalesce("n_procs", F.lit(0)).cast("long").alias("n_procs"),
                      F.coalesce("names", F.array().cast("array<string>")).alias("names"))
