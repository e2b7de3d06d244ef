"""Action events to tokens and back, bursts, controls and the safety gate, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the action vocabulary
KIND_TOKENS = {"NOOP": 2, "CLICK": 3, "DOUBLE_CLICK": 4, "RIGHT_CLICK": 5, "DRAG": 6, "SCROLL": 7, "TYPE": 8, "HOTKEY": 9, "WAIT": 10, "CANCEL": 11}
END = 1
COORD_BASE, SCROLL_BASE, DURATION_BASE, BYTE_BASE, KEY_BASE, VOCAB = 12, 268, 524, 652, 908, 940
BURST = 16
POINTERS = ("CLICK", "DOUBLE_CLICK", "RIGHT_CLICK")


def utf8_bytes(text: Column) -> Column:
    raw = F.encode(text, "UTF-8")
    n = F.octet_length(raw)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("int"))
    return F.when(n > 0, each).otherwise(F.array().cast("array<int>"))


def _bin(x: Column, top: int) -> Column:
    return F.bround(x * top).cast("int")


def reject_reason(kind: Column, coords: Column, scroll: Column, duration: Column, text: Column, keys: Column, max_ms: float) -> Column:
    """Why an event has no tokens; null if it has."""
    need = F.when(kind == "DRAG", 4).otherwise(2)
    return (
        F.when(kind.isNull() | ~kind.isin(*KIND_TOKENS), "unknown kind")
        .when(kind.isin(*POINTERS, "DRAG") & (coords.isNull() | (F.size(coords) != need)), "coordinates missing")
        .when(kind.isin(*POINTERS, "DRAG") & ~F.forall(coords, lambda c: c.between(0, 1)), "coordinates out of range")
        .when((kind == "SCROLL") & (scroll.isNull() | (F.size(scroll) != 2)), "deltas missing")
        .when((kind == "SCROLL") & ~F.forall(scroll, lambda c: c.between(-1, 1)), "deltas out of range")
        .when((kind == "WAIT") & duration.isNull(), "duration missing")
        .when((kind == "WAIT") & ~duration.between(0, max_ms), "duration out of range")
        .when((kind == "TYPE") & text.isNull(), "text missing")
        .when((kind == "HOTKEY") & (keys.isNull() | (F.size(keys) == 0)), "keys missing")
        .when((kind == "HOTKEY") & ~F.forall(keys, lambda k: k.between(0, VOCAB - KEY_BASE - 1)), "key out of range")
    )


def encode(kind: Column, coords: Column, scroll: Column, duration: Column, text: Column, keys: Column, max_ms: float = 10_000.0) -> Column:
    """array<int>: kind, quantised arguments (half-even), END. Null where ``reject_reason`` speaks."""
    start = F.lit(None).cast("int")
    for name, token in KIND_TOKENS.items():
        start = F.when(kind == name, F.lit(token)).otherwise(start)
    none = F.array().cast("array<int>")
    body = (
        F.when(kind.isin(*POINTERS, "DRAG"), F.transform(coords, lambda c: F.lit(COORD_BASE) + _bin(c, 255)))
        .when(kind == "SCROLL", F.transform(scroll, lambda c: F.lit(SCROLL_BASE) + _bin((c + 1.0) * 0.5, 255)))
        .when(kind == "WAIT", F.array(F.lit(DURATION_BASE) + _bin(duration / max_ms, 127)))
        .when(kind == "TYPE", F.transform(utf8_bytes(text), lambda b: b + BYTE_BASE))
        .when(kind == "HOTKEY", F.transform(keys, lambda k: k + KEY_BASE))
        .otherwise(none)
    )
    ok = reject_reason(kind, coords, scroll, duration, text, keys, max_ms).isNull()
    return F.when(ok, F.concat(F.array(start), body, F.array(F.lit(END))))


def grammar_error(tokens: Column) -> Column:
    """Why a token array is no action; null if it is one."""
    kind, body = F.element_at(tokens, 1), F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 2, F.lit(0)))
    within = lambda lo, hi: F.forall(body, lambda t: (t >= lo) & (t < hi))
    return (
        F.when(tokens.isNull() | (F.size(tokens) == 0), "empty")
        .when((F.element_at(tokens, -1) != END) | (F.size(tokens) < 2), "no end")
        .when(~kind.between(2, 11), "unknown kind")
        .when(kind.isin(2, 11) & (F.size(body) > 0), "takes no arguments")
        .when(kind.isin(3, 4, 5, 6) & ((F.size(body) != F.when(kind == 6, 4).otherwise(2)) | ~within(COORD_BASE, SCROLL_BASE)), "bad coordinates")
        .when((kind == 7) & ((F.size(body) != 2) | ~within(SCROLL_BASE, DURATION_BASE)), "bad deltas")
        .when((kind == 10) & ((F.size(body) != 1) | ~within(DURATION_BASE, BYTE_BASE)), "bad duration")
        .when((kind == 8) & ~within(BYTE_BASE, KEY_BASE), "bad bytes")
        .when((kind == 8) & F.try_validate_utf8(_text_bytes(body)).isNull(), "bad text")
        .when((kind == 9) & ((F.size(body) == 0) | ~within(KEY_BASE, VOCAB)), "bad keys")
    )


def _text_bytes(body: Column) -> Column:
    return F.unhex(F.array_join(F.transform(body, lambda t: F.lpad(F.hex((t - BYTE_BASE).cast("long")), 2, "0")), ""))


def decode(tokens: Column, max_ms: float = 10_000.0) -> Column:
    """Struct (kind, coordinates, scroll, duration_ms, text, keys); null where the grammar fails."""
    kind, body = F.element_at(tokens, 1), F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 2, F.lit(0)))
    name = F.lit(None).cast("string")
    for n, t in KIND_TOKENS.items():
        name = F.when(kind == t, F.lit(n)).otherwise(name)
    s = F.struct(
        name.alias("kind"),
        F.when(kind.isin(3, 4, 5, 6), F.transform(body, lambda t: (t - COORD_BASE) / 255.0)).alias("coordinates"),
        F.when(kind == 7, F.transform(body, lambda t: (t - SCROLL_BASE) / 127.5 - 1.0)).alias("scroll"),
        F.when(kind == 10, (F.element_at(body, 1) - DURATION_BASE) / 127.0 * max_ms).alias("duration_ms"),
        F.when(kind == 8, F.decode(_text_bytes(body), "UTF-8")).alias("text"),
        F.when(kind == 9, F.transform(body, lambda t: t - KEY_BASE)).alias("keys"),
    )
    return F.when(grammar_error(tokens).isNull(), s)


def bursts(tokens: Column, size: int = BURST) -> Column:
    """array<array<int>> of at most ``size`` tokens; empty for none."""
    n = F.floor((F.size(tokens) - 1) / size).cast("int")
    return F.when(F.size(tokens) > 0, F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(tokens, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<array<int>>"))


def controls(tokens: Column, event_id: Column) -> Column:
    """array<struct> of physical controls: one a hot key, one otherwise; null where the grammar fails."""
    kind, body = F.element_at(tokens, 1), F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 2, F.lit(0)))
    at = lambda i: (F.get(body, F.lit(i)) - COORD_BASE) / 255.0
    name = (
        F.when(kind == 2, "NOOP").when(kind == 11, "CANCEL").when(kind.isin(3, 4, 5), "POINTER_BUTTON").when(kind == 6, "POINTER_DRAG")
        .when(kind == 7, "SCROLL").when(kind == 8, "TEXT_INPUT").when(kind == 10, "WAIT")
    )
    pointer = kind.isin(3, 4, 5, 6)
    one = F.struct(
        event_id.alias("event_id"), name.alias("control"),
        F.when(pointer, at(0)).alias("x"), F.when(pointer, at(1)).alias("y"), F.when(kind == 6, at(2)).alias("x2"), F.when(kind == 6, at(3)).alias("y2"),
        F.when(kind == 7, (F.get(body, F.lit(0)) - SCROLL_BASE) / 127.5 - 1).alias("dx"), F.when(kind == 7, (F.get(body, F.lit(1)) - SCROLL_BASE) / 127.5 - 1).alias("dy"),
        F.when(kind == 10, F.bround((F.get(body, F.lit(0)) - DURATION_BASE) / 127 * 10_000).cast("int")).alias("duration_ms"),
        F.when(kind == 8, F.decode(_text_bytes(body), "UTF-8")).alias("text"),
        F.lit(None).cast("int").alias("key"), F.when(kind.isin(3, 4), 0).when(kind == 5, 2).cast("int").alias("button"),
    )
    d, i = F.lit(None).cast("double"), F.lit(None).cast("int")
    keys = F.transform(
        body,
        lambda t, k: F.struct(
            F.concat(event_id, F.lit("-"), k.cast("string")).alias("event_id"), F.lit("KEY_PRESS").alias("control"), d.alias("x"), d.alias("y"), d.alias("x2"), d.alias("y2"),
            d.alias("dx"), d.alias("dy"), i.alias("duration_ms"), F.lit(None).cast("string").alias("text"), (t - KEY_BASE).alias("key"), i.alias("button"),
        ),
    )
    return F.when(grammar_error(tokens).isNull(), F.when(kind == 9, keys).otherwise(F.array(one)))


def safety_violation(revision: Column, current: Column, duration: Column, control: Column, approved: Column, text: Column, key: Column, approval_for: tuple[str, ...] = (), max_ms: int = 10_000) -> Column:
    """The first rule that a control breaks; null if none."""
    needs = control.isin(*approval_for) if approval_for else F.lit(False)
    return (
        F.when(revision.isNotNull() & (revision != current), "stale revision")
        .when(duration > max_ms, "duration over limit")
        .when(needs & ~F.coalesce(approved, F.lit(False)), "approval required")
        .when((control == "TEXT_INPUT") & text.isNull(), "text missing")
        .when(control.isin("KEY_PRESS", "KEY_RELEASE") & key.isNull(), "key missing")
    )
