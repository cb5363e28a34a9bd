"""What a crash record shows, and which known causes that speaks for.

A record is searched once for each piece of evidence, part by part; the names of what is found make an
array of facts. A cause is a set of facts, or several sets of which one is enough, so both tables
are plain data and a user may pass others. Null inputs show nothing.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.predicates import has_ascii_run, matched
from tessera.functions.scalars import bound

# What stands in each part of a record, as regular expressions, under the name of the fact.
EVIDENCE: dict[str, dict[str, str]] = {
    "signal": {"bus_error": "SIGBUS", "bad_access": "^SIG(?:SEGV|BUS)$"},
    "code": {"object_specific": "^BUS_OBJERR$"},
    "thread": {"collector_thread": "^OS_GC_Thread$", "worker_thread": "OS_(?:FFRT|IPC)|Worker|TaskPool"},
    "message": {
        "allocation_failed": r"\[gc].*(?:Out of Memory|OOM fatal when trying to allocate|pool is empty in GC unexpectedly|SharedHeap OOM)",
        "bad_descriptor": r"errno is (?:9|22)\b",
        "exception_type": r"terminating due to uncaught exception of type \S+",
        "foreign_thread": "Fatal: ecma_vm cannot run in multi-thread!",
        "impossible_type": "(?i)this branch is unreachable|unreachable type|illegal.*type",
    },
    "stack": {
        "allocator": r"libark_jsruntime\.so\(.*(?:HandleUncatchableError|AllocateAlignedRegion|CollectGarbageFinish|ThrowOutOfMemoryError)",
        "async_path": "ThreadSafeCallback|NativeSafeAsyncWork|NativeAsyncWork|TaskPool",
        "binding": "libark_jsruntime|libace_napi|napi_|ArkNativeReference|InternalJSMemberFunctionCallback|ThreadSafeCallback|NativeAsyncWork|TaskPool",
        "event_loop": r"libuv\.so",
        "event_queue": "uv_ffrt_work|uv_queue_done|uv_queue_work|uv_async_send",
        "marking": "ConcurrentMarker|NonMovableMarker|ProcessMarkStack",
        "memory_tracking": r"libmemtracker\.so|mem_abort",
        "moving": "EvacuateObject|FullGCRunner|CompressGCMarker",
        "native_call": "napi_|ArkNativeReference",
        "native_surface": r"OH_NativeXComponent",
        "object_update": "napi_wrap|ObjectRef::DefineProperty|ObjectOperator::AddProperty",
        "script_object": "libark_jsruntime|JSFunction|InternalJSMemberFunctionCallback|XComponent",
        "sqlite": "sqlite",
        "surface_gone": "XComponentPattern::OnSurfaceDestroyed",
        "surface_library": r"libace_ndk\.z\.so",
    },
    "top frame": {"loop_closing": "uv_run|uv__run_closing_handles|uv__finish_close|uv__queue_remove|uv_close", "loop_on_top": r"libuv\.so"},
    "native frame": {
        "reference_call": "napi_delete_reference|napi_get_reference_value|napi_get_(?:undefined|null|boolean)|"
        r"napi_create_(?:object|array|int64|int32|uint32|string_\w+|reference)|ArkNativeReference::ArkNativeReference",
    },
}
# The frame that calls into the runtime, the frames that alone leave no caller to blame, the end of the null page.
NATIVE_FRAME = r"libace_napi\.z\.so.*napi_|ArkNativeReference"
COLLECTOR_FRAME = r"libark_jsruntime|libc\.so|libc\+\+|ld-musl|libffrt|Not mapped|Unknown"
NULL_PAGE = 4096
#: Patterns that are plain text, or several.
_PLAIN = re.compile(r"(?:[\w:]|\\\.)+(?:\|(?:[\w:]|\\\.)+)*")

#: Causes by where they lie: memory, the collector, the script binding, the event loop, the system.
CAUSES: dict[str, Sequence[Sequence[str]]] = {
    "heap_exhausted": (["allocator"], ["allocation_failed"]),
    "memory_tracker": (["memory_tracking"],),
    "found_while_marking": (["collector_thread", "marking", "bad_access", "address", "runtime_only"],),
    "found_while_moving": (["collector_thread", "moving", "impossible_type", "runtime_only"],),
    "null_object_offset": (["null_page", "script_object", "binding"],),
    "object_access_in_callback": (["address", "object_update", "async_path"],),
    "object_overwritten_by_text": (["text_address", "binding"],),
    "vm_shared_by_threads": (["foreign_thread"],),
    "wild_reference": (["reference_call"],),
    "binding_in_worker": (["native_call", "worker_thread"],),
    "async_task": (["event_loop", "event_queue"],),
    "handle_closed_early": (["loop_on_top", "loop_closing"],),
    "descriptor_closed_twice": (["bad_descriptor"],),
    "database_page": (["bus_error", "object_specific", "sqlite"],),
    "surface_lifecycle": (["surface_gone"], ["surface_library", "native_surface"]),
    "uncaught_exception": (["exception_type"],),
}


def _shows(part: Column, pattern: str) -> Column:
    """``part.rlike(pattern)``; alternatives that are plain text are looked for as such, which is faster."""
    if not _PLAIN.fullmatch(pattern):
        return part.rlike(pattern)
    return reduce(Column.__or__, [part.contains(text.replace(r"\.", ".")) for text in pattern.split("|")])


def crash_facts(
    frames: Column, message: Column, signal: Column, code: Column, address: Column, thread: Column, evidence: Mapping[str, Mapping[str, str]] = EVIDENCE
) -> Column:
    """Names of the pieces of evidence in a record, and of what its address and frames are like."""
    parts = {
        "signal": signal, "code": code, "thread": thread, "message": message, "stack": F.array_join(frames, "\n"), "top frame": F.get(frames, 0),
        "native frame": F.get(F.filter(frames, lambda f: f.rlike(NATIVE_FRAME)), 0), "at": address,
        "runtime_only": (F.size(frames) > 0) & F.forall(frames, lambda f: f.rlike(COLLECTOR_FRAME)),
    }

    def found(part: Column) -> Column:
        facts = {name: _shows(part[of], pattern) for of, patterns in evidence.items() for name, pattern in patterns.items()}
        facts |= {"address": part["at"].isNotNull(), "null_page": part["at"] <= NULL_PAGE, "text_address": has_ascii_run(part["at"])}
        return matched(facts | {"runtime_only": part["runtime_only"]})

    return bound(F.struct(*[value.alias(name) for name, value in parts.items()]), found)


def crash_causes(facts: Column, causes: Mapping[str, Sequence[Sequence[str]]] = CAUSES) -> Column:
    """Names of the causes of which some set of facts is there whole."""

    def met(facts: Column) -> Column:
        def whole(needed: Sequence[str]) -> Column:
            wanted = F.array(*[F.lit(n) for n in needed])
            return F.size(F.array_except(wanted, facts)) == 0

        return matched({cause: reduce(Column.__or__, map(whole, ways), F.lit(False)) for cause, ways in causes.items()})

    return bound(facts, met)
