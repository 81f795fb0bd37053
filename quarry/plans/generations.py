"""Versioned, verified, immutable table sets behind one pointer.

A generation is a folder of Parquet tables and a receipt, all written by Spark, so it may lie in any store. The pointer is a small table of one row
per publication; the current generation is the one of the highest number. Readers never see half a build, as the receipt comes last and only a
receipt's generation can be published.

A table may lie in buckets (`Part`): a build then writes those that it touches, and its receipt names, for each of the others, the earlier generation
that wrote it. Only what was written is read back and digested, and verified when it is published; `verify` goes through all.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import re
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.maintenance import row_hash, set_digest


#: Seconds after which a publisher that has claimed a number and not published counts as lost.
CLAIM = 60.0
#: The version of receipts and plans; a build of another one is not taken up.
VERSION = 1


#: The column by which a table lies in buckets.
BUCKET = "bucket"


@dataclass(frozen=True)
class Part:
    """A table of `of` buckets. rows: those of the touched buckets (all, where that is None), with their BUCKET; the other buckets stay as the
    generation `before` has them."""

    rows: DataFrame | Callable
    of: int
    touched: list[int] | None = None
    before: str | None = None


class Conflict(RuntimeError):
    """Someone else published meanwhile."""


class Generations:
    def __init__(self, spark: SparkSession, folder: str, claim: float = CLAIM):
        self.spark, self.folder, self.claim = spark, folder.rstrip("/"), claim
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self.open: dict[str, dict] = {}  # entries of builds that are not sealed yet

    def _at(self, *parts: str) -> str:
        return "/".join([self.folder, *parts])

    def _digest(self, df: DataFrame) -> dict:
        r = set_digest(df.select(*[F.to_json(F.struct(F.col(c))).alias(c) for c in sorted(df.columns)]), *sorted(df.columns)).first()
        return {"rows": r["n"], "digest": r["digest_sum"], "schema": df.schema.jsonValue()}

    def _buckets(self, name: str, table: str) -> dict:
        """Of each bucket of a table that a build wrote its rows and digest."""
        at = self._at("builds", name, table)
        if not any(x.getPath().getName().startswith(f"{BUCKET}=") for x in self.fs.listStatus(self.path(at))):  # no row at all
            return {}
        df = self.spark.read.parquet(at)
        columns = sorted(c for c in df.columns if c != BUCKET)
        part = F.conv(F.substring(row_hash(*columns), 1, 12), 16, 10).cast("decimal(38,0)")
        found = df.select(BUCKET, *[F.to_json(F.struct(F.col(c))).alias(c) for c in columns]).groupBy(BUCKET).agg(F.count("*").alias("n"), F.sum(part).cast("string").alias("digest"))
        return {str(r[BUCKET]): {"at": name, "rows": r["n"], "digest": r["digest"]} for r in found.collect()}  # one row a bucket

    def _now(self) -> float:
        """The time by the store's own clock, as its files have it."""
        at = self.path(self._at("clock", uuid.uuid4().hex))
        self.fs.create(at, True).close()
        out = self.fs.getFileStatus(at).getModificationTime() / 1000
        self.fs.delete(at, False)
        return out

    @contextlib.contextmanager
    def _leased(self, name: str):
        """While a build is written its lease is renewed; it ends with the build, or runs out when its builder is lost."""
        at, over = self.path(self._at("leases", name)), threading.Event()

        def renew():
            while not over.wait(self.claim / 4):
                self.fs.create(at, True).close()

        self.fs.create(at, True).close()
        thread = threading.Thread(target=renew, daemon=True)
        thread.start()
        try:
            yield
        finally:
            over.set()
            thread.join()
            self.fs.delete(at, False)

    def leased(self, name: str) -> bool:
        """Whether someone is at work on a build."""
        at = self.path(self._at("leases", name))
        return self.fs.exists(at) and self._now() - self.fs.getFileStatus(at).getModificationTime() / 1000 < self.claim

    def build(self, tables: dict[str, DataFrame | Callable | Part], settings: dict | None = None, name: str | None = None, origin: str | None = None) -> str:
        """Write all tables in their order, read them back, and seal them with a receipt. A table may be a function of a reader of the
        tables written before it. Gives the generation's name.

        ST5: origin names what the tables are made from. An unsealed build of the same version, settings, tables and origin on which nobody is at
        work is taken up: tables that were finished stay, the others are written anew. Without an origin every build starts anew."""
        plan = json.dumps({"version": VERSION, "settings": settings or {}, "tables": list(tables), "origin": origin}, sort_keys=True)
        name = name or (self.resumable(plan) if origin is not None else None) or f"g{int(time.time() * 1e6)}"
        if self.planned(name) != plan:
            self.spark.createDataFrame([(plan,)], "plan string").coalesce(1).write.mode("errorifexists").json(self._at("builds", name, "_plan.json"))
        with self._leased(name):
            receipt = {"version": VERSION, "settings": settings or {}, "tables": {}}
            self.open[name] = receipt["tables"]
            for t, df in tables.items():
                part, df = (df, df.rows) if isinstance(df, Part) else (None, df)
                if not self.fs.exists(self.path(self._at("builds", name, t, "_SUCCESS"))):
                    df = df(lambda t, buckets=None: self.read(t, name, buckets)) if callable(df) and not isinstance(df, DataFrame) else df
                    if part is not None:
                        plain = df.drop(BUCKET).limit(0).coalesce(1)  # the columns, where no bucket has a row
                        plain.write.mode("overwrite").parquet(self._at("builds", name, f"_{t}.columns"))
                        df = df.repartition(BUCKET)
                    (df.write.partitionBy(BUCKET) if part is not None else df.write).mode("overwrite" if origin is not None else "errorifexists").parquet(self._at("builds", name, t))
                receipt["tables"][t] = self._entry(name, t, part)
            self.spark.createDataFrame([(json.dumps(receipt, sort_keys=True),)], "receipt string").coalesce(1).write.json(self._at("builds", name, "_receipt.json"))
            del self.open[name]
        return name

    def _entry(self, name: str, t: str, part: Part | None) -> dict:
        if part is None:
            return self._digest(self.spark.read.parquet(self._at("builds", name, t)))
        schema = self.spark.read.parquet(self._at("builds", name, f"_{t}.columns")).schema.jsonValue()
        held = {} if part.before is None or part.touched is None else self.receipt(part.before)["tables"][t]["buckets"]
        buckets = {b: x for b, x in held.items() if int(b) not in set(part.touched or ())} | self._buckets(name, t)
        return {"schema": schema, "of": part.of, "buckets": buckets, **self._total(buckets)}

    @staticmethod
    def _total(buckets: dict) -> dict:
        digest = sum(int(x["digest"]) for x in buckets.values())
        return {"rows": sum(x["rows"] for x in buckets.values()), "digest": str(digest) if buckets else None}

    def planned(self, name: str) -> str | None:
        """The plan of a build, or None where there is none that can be read."""
        try:
            return self.spark.read.schema("plan string").json(self._at("builds", name, "_plan.json")).first()["plan"]
        except Exception:
            return None

    def unsealed(self) -> list[str]:
        at = self.path(self._at("builds"))
        names = sorted((s.getPath().getName() for s in self.fs.listStatus(at)), reverse=True) if self.fs.exists(at) else []
        return [n for n in names if not self.fs.exists(self.path(self._at("builds", n, "_receipt.json")))]

    def resumable(self, plan: str) -> str | None:
        """ST5: the latest unsealed build of this plan that nobody is at work on."""
        return next((n for n in self.unsealed() if self.planned(n) == plan and not self.leased(n)), None)

    def metadata(self, name: str | None = None) -> dict:
        """The receipt of a generation (the current one); empty where there is none or none that can be read."""
        try:
            return self.receipt(name or self.current or "")
        except Exception:
            return {}

    def receipt(self, name: str) -> dict:
        at = self._at("builds", name, "_receipt.json")
        if not self.fs.exists(self.path(at)):
            raise ValueError(f"{name} is not sealed")
        return json.loads(self.spark.read.schema("receipt string").json(at).first()["receipt"])

    def verify(self, name: str, written: bool = False) -> list[str]:
        """What differs from the receipt; nothing if the generation is whole. written: of tables in buckets only those are read that it wrote itself."""
        wrong = []
        for t, said in self.receipt(name)["tables"].items():
            try:
                if "buckets" in said:
                    now = {b: x for at in {x["at"] for x in said["buckets"].values()} if at == name or not written for b, x in self._buckets(at, t).items() if said["buckets"].get(b, {}).get("at") == at}
                    wrong += [f"{t}: bucket {b}" for b, x in said["buckets"].items() if (x["at"] == name or not written) and now.get(b) != x]
                    wrong += [f"{t}: rows" for _ in range(self._total(said["buckets"])["rows"] != said["rows"])]
                    continue
                now = self._digest(self.spark.read.parquet(self._at("builds", name, t)))
            except Exception as e:  # a lost table
                wrong.append(f"{t}: {type(e).__name__}")
                continue
            wrong += [f"{t}: {k}" for k in ("rows", "digest", "schema") if now[k] != said[k]]
        return wrong

    def history(self) -> list[tuple[int, str]]:
        at = self.path(self._at("pointer"))
        if not self.fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(at)]
        return sorted((int(m[1]), m[2]) for n in names if (m := re.fullmatch(r"(\d+)-(.+)", n)))

    @property
    def current(self) -> str | None:
        h = self.history()
        return h[-1][1] if h else None

    def activate(self, name: str, expected: str | None = None, written: bool = False) -> None:
        """Point to a verified generation, if the current one is still the expected one. written: what it shares with earlier ones isn't read again."""
        if wrong := self.verify(name, True) if written else self.verify(name):
            raise ValueError(f"{name}: {', '.join(wrong)}")
        h = self.history()
        if (h[-1][1] if h else None) != expected:
            raise Conflict(f"current is {h[-1][1] if h else None}, expected {expected}")
        number = self._claimed(h[-1][0] if h else 0)
        self.fs.mkdirs(self.path(self._at("pointer", f"{number}-{name}")))
        if (now := self.history()[-1]) != (number, name):
            raise Conflict(f"{now[1]} was published meanwhile")

    def _claimed(self, last: int) -> int:
        """A number above the last publication's that no one else has. A file of each number is made exactly once, whoever comes first. A
        claim without a publication is someone at work, or after CLAIM seconds someone lost, whose number is passed over."""
        folder = self.path(self._at("claims"))
        self.fs.mkdirs(folder)
        later = sorted((int(s.getPath().getName()), s.getModificationTime() / 1000) for s in self.fs.listStatus(folder) if int(s.getPath().getName()) > last)
        if later and self._now() - max(at for _, at in later) < self.claim:
            raise Conflict(f"publication {later[-1][0]} is under way")
        number = max([last, *(n for n, _ in later)]) + 1
        try:
            self.fs.create(self.path(self._at("claims", str(number))), False).close()
        except Exception as e:
            raise Conflict(f"publication {number} is taken") from e
        return number

    def rollback(self) -> str:
        """Back to the generation before the current one."""
        h = self.history()
        back = next((n for _, n in reversed(h) if n != h[-1][1]), None) if h else None
        if back is None:
            raise ValueError("there is nothing to go back to")
        self.activate(back, h[-1][1])
        return back

    def whole(self, name: str) -> bool:
        """Whether a generation is all its receipt says, and the receipt can be read."""
        try:
            return not self.verify(name)
        except Exception:
            return False

    def admitted(self, name: str | None = None) -> dict[str, DataFrame]:
        """The tables of a sealed generation to be read from. It has to hold what its receipt says, and nothing besides."""
        name = name or self.current
        if name is None:
            raise ValueError("no generation is active")
        if wrong := self.verify(name):
            raise ValueError(f"{name}: {', '.join(wrong)}")
        said = set(self.receipt(name)["tables"])
        held = {s.getPath().getName() for s in self.fs.listStatus(self.path(self._at("builds", name)))} - {"_receipt.json", "_plan.json"}
        held = {h for h in held if not re.fullmatch(r"_.*\.columns", h)}
        if more := sorted(held - said):
            raise ValueError(f"{name}: not in the receipt: {', '.join(more)}")
        return {t: self.read(t, name) for t in sorted(said)}

    def recovered(self) -> str | None:
        """If the current generation is broken, the latest whole one of the history is published again, and its name given; the broken one stays
        where it is, unread. None if the current one is whole; an error if none is."""
        h = self.history()
        if not h or self.whole(h[-1][1]):
            return None
        back = next((n for n in dict.fromkeys(n for _, n in reversed(h[:-1])) if n != h[-1][1] and self.whole(n)), None)
        if back is None:
            raise ValueError(f"{h[-1][1]} is broken, and so is all before it: build anew")
        self.activate(back, h[-1][1])
        return back

    def fingerprint(self) -> str:
        """ST9: the publications and the current generation's files, by name, size and time; no content is read."""
        h = self.history()
        fold = hashlib.sha256(json.dumps(h).encode())
        if h:
            said, seen = self.metadata(h[-1][1]).get("tables", {}), []
            shared = [(x["at"], t, f"{BUCKET}={b}") for t, e in said.items() for b, x in e.get("buckets", {}).items() if x["at"] != h[-1][1]]
            for folder in [(h[-1][1],), *shared]:
                files = self.fs.listFiles(self.path(self._at("builds", *folder)), True)
                while files.hasNext():
                    f = files.next()
                    seen.append(f"{f.getPath()}\0{f.getLen()}\0{f.getModificationTime()}\n")
            fold.update("".join(sorted(seen)).encode())
        return fold.hexdigest()

    def read(self, table: str, name: str | None = None, buckets: list[int] | None = None) -> DataFrame:
        """buckets: those alone, of a table that lies in buckets."""
        name = name or self.current
        if name is None:
            raise ValueError("no generation is active")
        said = (self.open.get(name) or self.metadata(name).get("tables", {})).get(table, {})
        if "buckets" not in said:
            return self.spark.read.parquet(self._at("builds", name, table))
        schema = StructType.fromJson(said["schema"])
        paths = [self._at("builds", x["at"], table, f"{BUCKET}={b}") for b, x in sorted(said["buckets"].items()) if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def stale(self, now: float, hours: float = 24) -> list[str]:
        """Unsealed builds older than so many hours; names without a time are left alone."""
        return sorted(n for n in self.unsealed() if (m := re.fullmatch(r"g(\d+)", n)) and int(m[1]) / 1e6 < now - hours * 3600)

    def drop(self, name: str) -> None:
        """Abort a build or remove a generation that no publication names."""
        if name in {n for _, n in self.history()}:
            raise ValueError(f"{name} has been published")
        self.fs.delete(self.path(self._at("builds", name)), True)


class Freshness:
    """ST9: proofs that what is served is what was sealed. A proof reads all tables; while the store's fingerprint stays as it was before and after the
    last good proof, none is made. Time alone never makes a proof good."""

    def __init__(self, store: Generations):
        self.store, self.accepted, self.lock = store, None, threading.Lock()

    def drift(self) -> list[str]:
        """What is wrong; nothing if all is well."""
        with self.lock:
            accepted, self.accepted = self.accepted, None
            name = self.store.current
            if name is None:
                return ["no generation is active"]
            try:
                before = self.store.fingerprint()
                if before == accepted:
                    self.accepted = accepted
                    return []
                wrong = self.store.verify(name)
                if not wrong and self.store.fingerprint() != before:
                    wrong = ["the store changed while it was verified"]
            except Exception as e:
                return [f"the store cannot be read: {type(e).__name__}"]
            self.accepted = None if wrong else before
            return wrong
