"""Crash, freeze and heap classifiers on records made by hand."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tessera.functions import predicates as P
from tessera.functions.crashes import crash_causes, crash_facts

JS = "/system/lib64/libark_jsruntime.so(JSFunction+4)"
CRASHES = [
    (["/lib/libc.so(abort+1)"], "terminating due to uncaught exception of type std::bad_alloc: no", "SIGABRT", None, None, "main", ["uncaught_exception"]),
    (["libark_jsruntime.so(panda::ThrowOutOfMemoryError+8)"], "", "SIGABRT", None, None, "main", ["heap_exhausted"]),
    ([JS, "libace_napi.z.so(napi_wrap+1)"], "", "SIGSEGV", "SEGV_MAPERR", 16, "main", ["null_object_offset"]),
    ([JS, "TaskPool"], "", "SIGSEGV", None, 0x6162636465666768, "TaskPoolThread", ["object_overwritten_by_text"]),
    (["libark_jsruntime.so(ConcurrentMarker+1)", "libc.so(start+2)"], "", "SIGSEGV", None, 0x90FF00FF00FF00FF >> 1, "OS_GC_Thread", ["found_while_marking"]),
    (["libark_jsruntime.so(FullGCRunner+1)"], "this branch is unreachable", "SIGABRT", None, None, "OS_GC_Thread", ["found_while_moving"]),
    (["libace_napi.z.so(napi_delete_reference+4)"], "", "SIGSEGV", None, None, "OS_IPC_3", ["wild_reference", "binding_in_worker"]),
    (["libuv.so(uv__run_closing_handles+4)"], "errno is 9", "SIGABRT", None, None, "main", ["handle_closed_early", "descriptor_closed_twice"]),
    (["libsqlite.z.so(sqlite3_step+1)"], "", "SIGBUS", "BUS_OBJERR", None, "main", ["database_page"]),
    (None, None, None, None, None, None, []),
    ([], "", "", "", 0, "", []),
]


def test_crash_features(spark):
    rows = [(k, *c[:4], None if c[4] is None else Decimal(c[4]), c[5]) for k, c in enumerate(CRASHES)]
    frame = spark.createDataFrame(rows, "k int, frames array<string>, message string, signal string, code string, address decimal(20,0), thread string")
    made = frame.select("k", crash_causes(crash_facts(*[F.col(c) for c in ("frames", "message", "signal", "code", "address", "thread")])).alias("f"))
    assert {r["k"]: r["f"] for r in made.collect()} == {k: c[6] for k, c in enumerate(CRASHES)}


@pytest.fixture
def of(spark):
    return lambda column: spark.range(1).select(column.alias("x")).first()["x"]


def test_reasons_and_addresses(of):
    parts = P.reason_parts(F.lit("Reason:Signal:SIGSEGV(SEGV_MAPERR)@0x00000000000010"))
    assert [of(parts[k]) for k in ("signal", "code")] == ["SIGSEGV", "SEGV_MAPERR"] and int(of(parts["address"])) == 16
    assert of(P.reason_parts(F.lit("nothing"))["address"]) is None
    assert [of(P.address_note(F.lit(a))) for a in (0, 8, 4096)] == ["null_base", "null_base_offset", None]
    assert of(P.stack_guard_note(F.lit(5000), F.lit(4096), F.lit("[stack]"))) == "stack_overflow"
    assert of(P.stack_guard_note(F.lit(5000), F.lit(None).cast("long"), F.lit(None).cast("string"))) == "outside_maps"


def test_frames(of):
    frames = F.array(F.lit("#00 ld-musl-aarch64.so.1(pthread_cond_timedwait)"), F.lit("#01 libc.so(x)"), F.lit("#02 /data/app/libentry.so(run)"))
    assert of(P.first_caller(frames)).startswith("#02") and of(P.waits_for_lock(frames))
    call = F.array(F.lit("libipc_common.z.so(WriteBinder)"), F.lit("libipc_core.z.so(TransactWithDriver)"))
    assert of(P.waits_for_call(call)) and not of(P.waits_for_call(frames))


def test_weak_names(of):
    assert [of(P.holds_weakly(F.lit(n))) for n in ("Weak_Map", "WeakRef#2", "Map")] == [True, True, False]


def test_facts_and_stack_are_computed_once(spark):
    """The plan named the stack and the facts anew for each piece of evidence and each cause."""
    frame = spark.range(1).select(F.array(F.lit("#0 libuv.so(uv_run)")).alias("frames"), F.lit("SIGBUS").alias("signal"), F.lit(1).cast("decimal(20,0)").alias("address"))
    made = frame.select(crash_causes(crash_facts(F.col("frames"), F.lit("none"), F.col("signal"), F.lit("BUS_OBJERR"), F.col("address"), F.lit("main"))).alias("causes"))
    plan = made._jdf.queryExecution().analyzed().toString()
    assert plan.count("array_join(") == 1 and made.first()["causes"] == ["handle_closed_early"]
