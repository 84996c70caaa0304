"""Aliases, masking with a leak check inside the output, and restoring.

Session keys live in a table (as the two padded keys of HMAC), never in a plan. A value's token is the head of its
HMAC; one value has one alias in a session. Where the aliases of two values of a session would be the same, or an alias
stands in a text already, longer tokens are tried. A session may have any number of values (a limit holds only if it is
asked for). A row that cannot be masked (it was refused by the scan, its session is unknown or over such a limit, no alias is
free) is refused alone, with its reason and without a text: masking fails closed.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce
from itertools import count

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe.streaming.shared import folder

from .by_session import with_own_pairs, with_session_pairs, with_session_row
from .detect import Rules, in_slices, with_hits
from .refused import Refused
from .rules import STRENGTH
from .scan import Finder
from .structure import path_alias_of, url_alias_of

PREFIX, DOMAIN = "MF", "example.invalid"
TAGS = {"PERSON": "PERSON", "ORGANIZATION": "ORG", "PROJECT_NAME": "PROJECT", "PRODUCT_NAME": "PRODUCT", "HOSTNAME": "HOST", "EMPLOYEE_ID": "EMP", "CUSTOMER_ID": "CUST", "JP_ADDRESS": "ADDR"}
SESSIONS = "session_id string, inner_pad binary, outer_pad binary"
REDACTED = "[REDACTED]"
#: Fixed value: lengths of tokens in the order tried.
LENGTHS = range(12, 33, 2)
#: Sessions with clashes and at most so many values are settled in a task, larger ones in rounds, with the same result.
TOGETHER = 10_000
#: A numeric alias of fewer digits could not be told from other numbers, so such values get the shape of prose.
LEAST_DIGITS = 7
_SHAPE = (
    r"MF_[A-Z]+_[0-9A-F]{12,}|mf-(?:host|user)-[0-9a-f]{12,}[.@]example\.invalid|(?:192\.0\.2|198\.51\.100|203\.0\.113)\.[0-9]{1,3}"
    r"|2001:db8::[0-9a-f]{1,16}|mf-(?:seg|host)-[0-9a-f]{8}|\$\{MF_SECRET_[0-9A-F]{12,}\}"
)


def session_table(spark: SparkSession, keys: dict[str, bytes]) -> DataFrame:
    rows = [(s, bytearray(b ^ 0x36 for b in k.ljust(64, b"\0")), bytearray(b ^ 0x5C for b in k.ljust(64, b"\0"))) for s, k in keys.items()]
    return spark.createDataFrame(rows, SESSIONS)


def hmac_sha256(inner: Column, outer: Column, message: Column) -> Column:
    """Hex digest; the keys are padded to 64 bytes already."""
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "utf-8")), 256))), 256)


def fingerprint(inner: Column, outer: Column, value: Column, entity: Column, profile: Column) -> Column:
    return hmac_sha256(inner, outer, F.concat_ws("\0", value, entity, profile))


def fingerprint_of(inner: bytes, outer: bytes, value: str, entity: str, profile: str) -> str:
    return hashlib.sha256(outer + hashlib.sha256(inner + "\0".join((value, entity, profile)).encode()).digest()).hexdigest()


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def has_alias_shape(text: Column) -> Column:
    """Whether a text holds anything of the shape of an alias, issued or not."""
    return F.coalesce(text.rlike(_SHAPE), F.lit(False))


def alias_of(profile: str, entity: str, token: str, original: str) -> str | None:
    """The alias of a shape; None where the shape cannot be kept (masking fails closed)."""
    digits = sum(c.isdigit() for c in original)
    if profile == "hostname":
        return f"mf-host-{token}.{DOMAIN}"
    if profile == "email":
        return f"mf-user-{token}@{DOMAIN}"
    if profile == "ipv4":
        n = int(token, 16)
        return f"{('192.0.2.', '198.51.100.', '203.0.113.')[n % 3]}{n // 3 % 254 + 1}"
    if profile == "ipv6":
        return f"2001:db8::{token[:16]}"
    if profile == "uuid":
        h = hashlib.sha256(token.encode()).hexdigest()
        return "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:32]))
    if profile == "numeric" and digits >= LEAST_DIGITS:
        blocks = (hashlib.sha256(f"{token}\x1f{k}".encode()).hexdigest() for k in range(digits // 64 + 1))
        return "".join(str(int(c, 16) % 10) for c in "".join(blocks)[:digits])
    if profile == "environment_reference":
        return f"${{{PREFIX}_SECRET_{token.upper()}}}"
    if profile == "url":
        return url_alias_of(token, original)
    if profile == "file_path":
        return path_alias_of(token, original)
    return f"{PREFIX}_{TAGS.get(entity, 'VALUE')}_{token.upper()}"


ALIASED = "array<struct<start:int,end:int,value:string,entity_type:string,profile:string,policy:string,fingerprint:string,alias:string,taken:boolean>>"


def _aliased(merge: bool):
    """Every hit with its fingerprint, the alias of the shortest token, and whether that alias could not be told in the text."""

    def some(texts: pa.Array, rows: pa.Array, inner: pa.Array, outer: pa.Array) -> pa.Array:
        out = []
        for text, hits, a, b in zip(texts, rows.to_pylist(), inner.to_pylist(), outer.to_pylist(), strict=True):
            cells, text = [], text.as_py() if hits else ""
            for h in hits or ():
                print_ = fingerprint_of(a, b, h["normalized" if merge else "value"], h["entity_type"], h["profile"])
                alias = REDACTED if h["policy"] == "redacted" else alias_of(h["profile"], h["entity_type"], print_[: LENGTHS[0]], h["value"])
                same = {k: h[k] for k in ("start", "end", "value", "entity_type", "profile", "policy")}
                taken = alias is not None and alias != REDACTED and alias in text
                if alias and alias.isdigit() and not taken:  # digits beside it would hide it from restoring
                    own = re.escape(h["value"])
                    taken = re.search(rf"\d{own}|{own}\d", text) is not None
                cells.append(same | {"fingerprint": print_, "alias": alias, "taken": taken})
            out.append(cells)
        kind = pa.struct([(n, pa.int32() if n in ("start", "end") else pa.bool_() if n == "taken" else pa.string()) for n in ("start", "end", "value", "entity_type", "profile", "policy", "fingerprint", "alias", "taken")])
        return pa.array(out, pa.list_(kind))

    @F.arrow_udf(ALIASED)
    def run(texts: pa.Array, rows: pa.Array, inner: pa.Array, outer: pa.Array) -> pa.Array:
        return in_slices(some, texts, rows, inner, outer)

    return run


def _tried(entity: str, profile: str, print_: str, value: str, taken: bool) -> list[str]:
    """The aliases of a value in the order in which it asks for them."""
    own = "prose_identifier" if taken and profile == "numeric" else profile
    every = (alias_of(own, entity, print_[:n], value) for n in LENGTHS if n > LENGTHS[0] or not taken or own != profile)
    return [a for a in every if a is not None]


def _free(rows: pa.Table) -> pa.Table:
    """One session's values, at most TOGETHER: aliases that differ from those of the shortest token. Known ones keep
    theirs, the others take in the order of their fingerprints the first that is free."""
    cells = sorted(rows.to_pylist(), key=lambda r: (r["known"] is None, r["fingerprint"], r["alias"]))
    used, out = {r["known"] for r in cells if r["known"]}, []
    for r in cells:
        alias = r["known"]
        if alias is None:
            tried = _tried(r["entity_type"], r["profile"], r["fingerprint"], r["value"], r["taken"])
            alias = next((a for a in tried if a not in used), None)  # None: the rows that hold the value are refused
            used.add(alias)
        if alias != r["alias"]:
            out.append((r["session_id"], r["fingerprint"], alias))
    names = ("session_id", "fingerprint", "alias")
    return pa.Table.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in range(3)], names=names)


def _asks(entity: pa.Array, profile: pa.Array, print_: pa.Array, value: pa.Array, taken: pa.Array) -> pa.Array:
    columns = (c.to_pylist() for c in (entity, profile, print_, value, taken))
    return pa.array([_tried(*r) for r in zip(*columns, strict=True)], pa.list_(pa.string()))


def _in_rounds(own: DataFrame) -> DataFrame:
    """What ``_free`` tells, of sessions of any number of values. In each round those that ask for an alias which one before
    them (a known one, or one of a smaller fingerprint) holds or asks for go on to the next alias that none such has. As all
    aliases rank values alike, this ends where taking turns ends, whatever the order. Values meet by session and alias, never
    by session alone; each round is written to the folder that driver and executors share."""
    spark, written = own.sparkSession, folder(own.sparkSession, "aliases")
    at, told = ["session_id", "alias"], ("session_id", "fingerprint", "alias")
    asks = F.arrow_udf(_asks, "array<string>")(*(F.col(c) for c in ("entity_type", "profile", "fingerprint", "value", "taken")))
    place = F.struct(F.col("known").isNull().alias("later"), "fingerprint", "first")
    state = own.withColumn("first", F.col("alias"))
    odd = F.col("known").isNull() & F.col("taken")
    state = state.where(~odd).withColumn("alias", F.coalesce("known", "first")).unionByName(state.where(odd).withColumn("alias", F.get(asks, F.lit(0))))
    state = state.withColumns({"place": place, "step": F.lit(0), "moved": F.lit(True)})
    columns, gone = state.columns, []
    value = [c for c in columns if c not in ("alias", "step", "moved")]
    for k in count():
        path = f"{written}/{k}"
        state.write.parquet(path)
        state = spark.read.schema(state.schema).parquet(path)
        gone.append(state.where("alias is null").select(*told))
        if state.where("moved").isEmpty():
            break
        asked = state.where("alias is not null")
        best = asked.groupBy(*at).agg(F.min("place").alias("least"))
        met, lost = asked.join(best, at), F.col("known").isNull() & (F.col("place") > F.col("least"))
        # the alias that was lost is among them, so that every value stays
        every = met.where(lost).select(*value, "step", F.posexplode(asks).alias("at", "alias")).where("at >= step")
        free = F.col("least").isNull() | (F.col("least") > F.col("place"))
        on = every.join(best, at, "left").groupBy(*value).agg(F.min(F.when(free, F.struct("at", "alias"))).alias("to"))
        on = on.select(*value, F.col("to.alias").alias("alias"), F.coalesce("to.at", F.lit(0)).alias("step"), F.lit(True).alias("moved"))
        state = met.where(~lost).withColumn("moved", F.lit(False)).select(*columns).unionByName(on)
    return reduce(DataFrame.unionByName, gone, state.where("alias <> first").select(*told))


def allocated(found: DataFrame, known: DataFrame | None = None, most: int | None = None, together: int = TOGETHER) -> tuple[DataFrame | None, DataFrame | None]:
    """found(session_id, aliased) -> (session_id, fingerprint, alias) of the values that cannot have the alias of the shortest
    token or have another one already (known: session_id, fingerprint, alias), null if none is free, and (session_id) of the
    sessions of more than ``most`` values, which are not settled; None where there are none. Counts are aggregated before they
    are shuffled; of sessions with such values those of at most ``together`` meet in a task, the others are settled in rounds."""
    rank = F.create_map(*(F.lit(x) for pair in STRENGTH.items() for x in pair))
    rows = found.select("session_id", F.inline("aliased")).where(f"policy <> 'redacted' and alias <> '{REDACTED}'")
    rows = rows.groupBy("session_id", "fingerprint", "alias", "entity_type", "profile").agg(F.min("value").alias("value"), F.max("taken").alias("taken"), F.max(rank[F.col("policy")]).alias("rank"))
    if known is None:
        rows = rows.withColumn("known", F.lit(None).cast("string"))
        others = None
    else:
        others = known.select("session_id", "fingerprint", F.col("alias").alias("known"))
        rows = rows.join(others, ["session_id", "fingerprint"], "left")
    rows = rows.persist(StorageLevel.DISK_ONLY)
    over = None
    if most is not None:
        over = rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("session_id")
        over = None if over.isEmpty() else over
    every = rows.select("session_id", "fingerprint", F.coalesce("known", "alias").alias("alias"), (F.col("taken") & F.col("known").isNull() | (F.col("known") != F.col("alias"))).alias("odd"))
    if others is not None:
        every = every.unionByName(others.select("session_id", "fingerprint", F.col("known").alias("alias"), F.lit(False).alias("odd")))
    clash = every.groupBy("session_id", "alias").agg(F.min("fingerprint").alias("a"), F.max("fingerprint").alias("b"), F.max("odd").alias("odd")).where("a <> b or odd")
    sessions = clash.select("session_id").distinct()
    if over is not None:
        sessions = sessions.join(over, "session_id", "left_anti")
    if sessions.isEmpty():
        rows.unpersist()
        return None, over
    columns = ("session_id", "fingerprint", "alias", "entity_type", "profile", "value", "taken", "known")
    own = rows.select(*columns)
    if others is not None:  # aliases of values that do not occur now are taken all the same
        rest = others.join(rows, ["session_id", "fingerprint"], "left_anti")
        own = own.unionByName(rest.select("session_id", "fingerprint", F.col("known").alias("alias"), *(F.lit("").alias(c) for c in ("entity_type", "profile", "value")), F.lit(False).alias("taken"), "known"))
    own = own.join(sessions, "session_id", "left_semi")
    wide = own.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > together).select("session_id")
    rounds = not wide.isEmpty()
    narrow = own.join(wide, "session_id", "left_anti") if rounds else own
    changed = narrow.groupBy("session_id").applyInArrow(_free, "session_id string, fingerprint string, alias string")
    if rounds:
        changed = changed.unionByName(_in_rounds(own.join(wide, "session_id", "left_semi")))
    return changed.groupBy("session_id", "fingerprint").agg(F.min("alias").alias("alias")), over


MASKED = "struct<masked:string,blocked_by:array<string>,aliases:array<struct<alias:string,value:string,entity_type:string,policy:string,fingerprint:string>>,error:string>"


def masked_text(text: str, hits: list[dict]) -> str:
    """The spans replaced by their aliases, exact repeats of a masked value elsewhere too, the longest first, in one pass,
    so that nothing is looked for inside an alias. An original that is left is an error."""
    values: dict[str, str] = {}
    for h in hits:
        if h["alias"] is None:
            raise Refused("NO_ALIAS_SHAPE")
        values.setdefault(h["value"], h["alias"])
    finder, out, rest, at = Finder(values), [], [], 0
    for start, end, alias in [*((h["start"], h["end"], h["alias"]) for h in hits), (len(text), len(text), "")]:
        gap, last = text[at:start], 0
        for a, b, v in finder.longest_first(gap):
            out += (gap[last:a], values[v])
            rest += (gap[last:a], "\0")
            last = b
        out += (gap[last:], alias)
        rest += (gap[last:], "\0")
        at = end
    left = "".join(rest)
    if any(v in left for v in values):
        raise Refused("ORIGINAL_LEFT")
    return "".join(out)


def masked_row(text: str | None, hits: list[dict], changed: dict[str, str | None], error: str | None) -> dict:
    """A row of MASKED; ``changed`` are aliases that differ from those of the hits, by fingerprint."""
    for h in hits:
        if h["policy"] == "redacted":
            h["alias"] = REDACTED
        elif h["fingerprint"] in changed:
            h["alias"] = changed[h["fingerprint"]]
            error = error or ("NO_FREE_ALIAS" if h["alias"] is None else None)
    blocked = sorted({h["entity_type"] for h in hits if h["policy"] == "block"})
    shown = None
    if not blocked and not error:
        try:
            shown = masked_text(text, hits) if hits else text
        except Refused as why:
            error = why.code
    return {"masked": shown, "blocked_by": [error] if error else blocked, "aliases": [{k: h[k] for k in ("alias", "value", "entity_type", "policy", "fingerprint")} for h in hits] if not error else [], "error": error}


def _masked(texts: pa.Array, rows: pa.Array, longer: pa.Array, errors: pa.Array) -> pa.Array:
    return in_slices(_masked_some, texts, rows, longer, errors)


def _masked_some(texts: pa.Array, rows: pa.Array, longer: pa.Array, errors: pa.Array) -> pa.Array:
    out = []
    for text, hits, more, error in zip(texts, rows.to_pylist(), longer.to_pylist(), errors.to_pylist(), strict=True):
        out.append(masked_row(text.as_py(), hits or [], dict(more or ()), error))
    string = pa.list_(pa.string())
    kind = pa.struct([("masked", pa.string()), ("blocked_by", string), ("aliases", pa.list_(pa.struct([(n, pa.string()) for n in ("alias", "value", "entity_type", "policy", "fingerprint")]))), ("error", pa.string())])
    return pa.array(out, kind)


def mask(
    df: DataFrame,
    sessions: DataFrame,
    keys: list[str],
    text: str,
    rules: Rules,
    *,
    known: DataFrame | None = None,
    merge_surface_forms: bool = False,
    most: int | None = None,
    **options,
) -> DataFrame:
    """df(keys, session_id, text) -> keys, session_id, masked, blocked_by, aliases(alias, value, entity_type, policy, fingerprint), error.

    A row with a blocking entity has no masked text but the list of its blocking types; null text stays null. A row that is
    refused has no masked text either, the code in ``error`` (``refused.split_quarantine`` makes two tables) and alone in
    ``blocked_by``; every row of ``df`` has one in the result. With ``most`` the rows of a session of more
    values are refused; without it a session has as many as it has. Aliases that the session has issued (``known``: what ``mappings`` tells) are kept for their values and are not looked into.
    With ``merge_surface_forms`` forms of a value that are equal when normalised share an alias. ``options`` are those
    of Scanner, and ``kind``. Rows and what is found in them are kept on the executors' disks (recomputed if lost, let go
    by ``spark.catalog.clearCache()``), because aliases are settled for whole sessions before texts are rewritten."""
    also = [options["kind"]] if options.get("kind") else []
    rows = df.select(*keys, "session_id", text, *(c for c in also if c not in keys))
    if known is not None:
        issued = known.groupBy("session_id").agg(F.array_sort(F.collect_set("alias")).alias("__issued"))
        rows = with_session_row(rows, issued, keys or [text])
        options["issued"] = "__issued"
    rows = with_session_row(with_hits(rows, text, rules, **options), sessions, keys or [text])
    error = F.when(F.col("inner_pad").isNull(), "NO_SESSION").otherwise(F.col("__error"))
    hits = F.when(F.col("inner_pad").isNotNull(), F.col("__hits"))
    found = rows.select(*keys, "session_id", text, error.alias("__error"), _aliased(merge_surface_forms)(F.col(text), hits, F.col("inner_pad"), F.col("outer_pad")).alias("aliased")).persist(StorageLevel.DISK_ONLY)
    longer, over = allocated(found, known, most)
    if longer is None:
        out = found.withColumn("longer", F.lit(None).cast("map<string,string>"))
    else:
        pairs = longer.select("session_id", F.col("fingerprint").alias("first"), F.col("alias").alias("second"))
        out = with_own_pairs(found, pairs, F.col("aliased.fingerprint"), keys or [text], "longer")
    if over is not None:
        told = over.withColumn("over", F.lit(True))
        out = with_session_row(out, told, keys or [text]).withColumn("__error", F.when(F.col("over"), "TOO_MANY_VALUES").otherwise(F.col("__error")))
    return out.withColumn("__out", F.arrow_udf(_masked, MASKED)(F.col(text), F.col("aliased"), F.col("longer"), F.col("__error"))).select(*keys, "session_id", "__out.*")


def mappings(masked: DataFrame) -> DataFrame:
    """session_id, alias, value, entity_type, policy, fingerprint: one row an alias; of a value's policies the strongest
    holds. An alias of two values is an error."""
    rank = F.create_map(*(F.lit(x) for pair in STRENGTH.items() for x in pair))
    rows = masked.where("masked is not null").select("session_id", F.inline("aliases")).where(f"alias <> '{REDACTED}'")
    one = rows.groupBy("session_id", "alias").agg(
        F.min("value").alias("value"), F.min("entity_type").alias("entity_type"), F.max(F.struct(rank[F.col("policy")].alias("r"), "policy")).alias("p"), F.min("fingerprint").alias("fingerprint"), F.max("fingerprint").alias("__other")
    )
    alias = F.when(F.col("fingerprint") == F.col("__other"), F.col("alias")).otherwise(F.raise_error(F.lit("two values share an alias")))
    return one.select("session_id", alias.alias("alias"), "value", "entity_type", F.col("p.policy").alias("policy"), "fingerprint")


def replaced(text: str, finder: Finder, values: dict[str, str]) -> str:
    """Aliases become their values in one pass, the longest first; one of digits alone must not touch another digit."""
    out, at = [], 0
    found = (m for m in sorted(finder.all(text), key=lambda m: (m[0], -m[1])))
    for a, b, v in found:
        bare = v.isdigit() and (text[a - 1 : a].isdigit() and a > 0 or text[b : b + 1].isdigit())
        if a >= at and not bare:
            out += (text[at:a], values[v])
            at = b
    return "".join([*out, text[at:]])


def aliases_of(values: dict[str, str]) -> tuple[Finder, dict[str, str]]:
    return Finder(dict(values)), dict(values)


def restore(df: DataFrame, known: DataFrame, keys: list[str], text: str, together: int = TOGETHER) -> DataFrame:
    """keys, session_id, restored: aliases of literal policy in ``text`` become their values again. A session's aliases go
    once to each part of its rows (``by_session``), those of a session of more than ``together`` only to parts with a text that
    holds them; rows need no key of their own. The aliases and, if there is such a session, the texts are kept on the
    executors' disks."""
    pairs = known.where("policy = 'literal'").select("session_id", F.col("alias").alias("first"), F.col("value").alias("second")).persist(StorageLevel.DISK_ONLY)
    rows = df.select(*dict.fromkeys([*keys, "session_id", text]))
    wide = pairs.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > together).select("session_id")
    if wide.isEmpty():
        wide = None
    else:
        rows = rows.persist(StorageLevel.DISK_ONLY)
    out = with_session_pairs(rows, pairs, text, aliases_of, lambda own, t, _: replaced(t, *own) if own and t else t, "restored", "string", wide)
    return out.select(*keys, "session_id", "restored")


def with_instruction(text: Column, known_aliases: Column, instruction: str) -> Column:
    """``text`` behind an instruction to keep aliases as they are, if the session has any."""
    return F.when(known_aliases > 0, F.concat_ws("\n\n", F.lit(instruction), text)).otherwise(text)


def sealed(value: Column, key: Column, context: Column) -> Column:
    """AES-256-GCM: nonce (12 bytes, random), ciphertext, tag. ``context`` (the fingerprint) must be the same to open it."""
    return F.aes_encrypt(F.encode(value, "utf-8"), key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), F.encode(context, "utf-8"))


def opened(blob: Column, key: Column, context: Column) -> Column:
    """The text that was sealed; an error with another key or context."""
    return F.decode(F.aes_decrypt(blob, key, F.lit("GCM"), F.lit("DEFAULT"), F.encode(context, "utf-8")), "utf-8")
