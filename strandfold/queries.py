"""The registered queries of the library's operators, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandfold.durable import durable, shared_dir
from strandfold.functions import kernels as K
from strandfold.functions import pixels
from strandfold.operators import align, candidates, coverage, exact, filters, groups, policy, tokens, verify
from strandfold.operators.components import connected_components
from strandfold.oracle import _DISTANCE, _FLAT, _TOKENS, sql
from strandfold.params import DOCUMENTS as P
from strandfold.plans import decisions as plans
from strandfold.sources import adapters, discovery, reports, stores
from strandfold.sources.runs import RunLog
from strandfold.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PERCENT = 50.0


def query(body: str | None = None):
    """Registers a function (Stage) -> DataFrame under its name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf_dir, f=f: f(Stage(spark, sf_dir))
        if body:
            ORACLES[f.__name__] = sql(body)
        return f

    return keep


class Stage:
    """The tables of a run over documents, each made when first asked for; items, points and matches are written since much reads them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.made = spark, sf_dir, {}

    def __getattr__(self, name: str):
        if name not in MAKERS:
            raise AttributeError(name)
        if name not in self.made:
            self.made[name] = MAKERS[name](self)
        return self.made[name]


def _matches(s: Stage) -> DataFrame:
    both = exact.exact_matches(s.suspects).unionByName(s.records)
    return durable(groups.numbered(filters.min_duplicate_percent(both, PERCENT), ["a_id", "b_id"], "match_id").select("match_id", *both.columns), "matches")


def _order(s: Stage) -> DataFrame:
    return policy.removal_priority(s.members, s.used, s.matches, s.items, "delete-shorter-name", P.interval, P.min_coverage)


def _decided(s: Stage) -> DataFrame:
    order = s.prior.where("group_id % 2 = 1").groupBy("group_id").agg(F.sort_array(F.collect_list(F.struct("place", "item_id"))).getField("item_id").alias("o"))
    return order.select("group_id", F.slice("o", 1, 1).alias("keeper_ids"), F.array_sort(F.slice("o", F.lit(2), F.size("o"))).alias("removal_order"), F.lit("manual").alias("method"))


def _inventory(s: Stage) -> DataFrame:
    size = F.col("size_bytes") + F.when(F.col("item_id") % 7 == 0, 1).otherwise(0)
    return s.items.where("item_id % 11 <> 0").select("item_id", size.alias("size_bytes"), "mtime_ns")


MAKERS: dict[str, Callable[[Stage], DataFrame]] = {
    "docs": lambda s: adapters.read(s.spark, s.sf_dir, "documents"),
    "items": lambda s: durable(adapters.document_items(s.docs), "items"),
    "suspects": lambda s: durable(exact.hashed_suspects(s.items, s.docs.select(F.col("doc_id").alias("item_id"), "text"), "text"), "suspects"),
    "samples": lambda s: adapters.document_samples(s.docs),
    "kept_samples": lambda s: durable(s.samples, "samples"),
    "fast": lambda s: adapters.fast_pass(s.kept_samples),
    "counts": lambda s: s.kept_samples.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")),
    "tokens": lambda s: tokens.item_tokens(s.kept_samples),
    "lists": lambda s: durable(tokens.selected_lists(s.kept_samples, P.token_limit), "lists"),
    "selected": lambda s: s.lists.select("item_id", F.explode("tokens").alias("token")),
    "rare": lambda s: tokens.drop_frequent(s.selected, P.max_frequency),
    "scores": lambda s: candidates.counts_of_lists(s.lists, P.max_frequency),
    "capped": lambda s: durable(candidates.best_of_lists(s.lists, P.max_frequency, P.min_shared, P.per_item), "capped"),
    "candidates": lambda s: candidates.without_pairs(s.capped, exact.exact_pair_keys(s.suspects, s.capped)),
    "likely": lambda s: durable(verify.verify_candidates(s.candidates, s.fast, s.items, P), "likely"),
    "points": lambda s: durable(verify.matching_points(s.likely, s.kept_samples, P.distance), "points"),
    "aligned": lambda s: durable(align.align_samples(s.likely, s.kept_samples, P), "aligned"),
    "records": lambda s: durable(align.match_records(s.aligned, s.items, P, s.counts), "records"),
    "matches": _matches,
    "classes": lambda s: durable(coverage.exact_classes(s.items, s.matches), "classes"),
    "clips": lambda s: durable(groups.clip_components(s.matches, s.classes), "clips"),
    "grouped": lambda s: groups.duplicate_groups(s.items, s.matches, s.classes),
    "members": lambda s: durable(s.grouped[0], "members"),
    "used": lambda s: durable(s.grouped[1], "used"),
    "prior": lambda s: durable(_order(s), "prior"),
    "decided": _decided,
    "inventory": _inventory,
    "user_bins": lambda s: adapters.event_bins(adapters.read(s.spark, s.sf_dir, "events")),
    "user_ranges": lambda s: coverage.compress_ranges(s.user_bins, ["item_id"]),
    "vectors": lambda s: adapters.read(s.spark, s.sf_dir, "embeddings"),
    "frames": lambda s: adapters.load_frames(adapters.page_frames(adapters.read(s.spark, s.sf_dir, "pages"))),
    "actions": lambda s: durable(plans.build_actions(s.decided, s.matches, s.items, P.interval, P.min_coverage, s.classes), "actions"),
    "log": lambda s: s.members.withColumn("seq", F.pmod(F.col("item_id") * 31 + F.col("group_id") * 7, F.lit(1009)) * 1000000 + F.col("group_id") * 1000 + F.col("item_id") % 1000)
    .where("(item_id + group_id) % 3 <> 0").select("seq", "group_id", "item_id", (F.col("item_id") % 2 == 0).alias("keep")),
    "store": lambda s: s.items.where("item_id % 3 = 0").select("path", "size_bytes", "mtime_ns", F.lit("fast").alias("kind"), F.lit(1.0).alias("interval"), F.lit(1).alias("written_at")),
    "failed": lambda s: s.items.where("item_id % 5 = 1").select("path", "size_bytes", "mtime_ns", F.lit("fast").alias("kind"), F.lit(1.0).alias("interval"), F.lit("cannot decode").alias("error")),
    "files": lambda s: s.items.select("item_id", "path", "size_bytes", "mtime_ns", F.lit("fast").alias("kind"), F.lit(1.0).alias("interval")),
}

_LOG = """log as (select ((item_id * 31 + group_id * 7) % 1009) * 1000000 + group_id * 1000 + item_id % 1000 as seq, group_id, item_id, item_id % 2 = 0 as keep from members where (item_id + group_id) % 3 <> 0)"""


# Sources and stores


@query("select lower(path) as path, size_bytes from items where path like '/src1/%' or path like '/src2/en/%'")
def discover_items(s):
    found = discovery.discover_items(s.items.select("path", "size_bytes"), ["/src1", "/src2/en"], -1, ("TXT",))
    return found.select(F.lower("path").alias("path"), "size_bytes")


@query("select item_id, row_number() over (order by path) - 1 as dense_id from items")
def assign_item_ids(s):
    return discovery.assign_item_ids(s.items.select("item_id", "path"), "dense_id").select("item_id", "dense_id")


@query("""select item_id, pos::int as pos, (pos * 3.0)::double as ts, md5(unhex(substr(h, pos * 1296 + 1, 1296))) as digest
    from (select page_id as item_id, hex(encode(html)) as h, unnest(range(octet_length(encode(html)) // 648)) as pos from pages)""")
def load_frames(s):
    return s.frames.select("item_id", "pos", "ts", F.md5("pixels").alias("digest"))


def _file_store(s) -> stores.FileStore:
    return stores.FileStore(s.spark, f"{shared_dir(s.spark)}/files-{s.spark.sparkContext.applicationId}-{uuid.uuid4().hex}")


@query("select item_id, item_id % 3 = 0 and item_id % 2 = 0 as hit from items")
def fingerprint_store_lookup(s):
    """A third of the files is stored, every other of them broken; what is broken is a miss and leaves the store."""
    store = _file_store(s)
    samples = F.array(F.struct(F.lit(0).alias("pos"), F.transform(F.sequence(F.lit(1), F.when(F.pmod("mtime_ns", F.lit(2)) == 0, 9).otherwise(8)), lambda k: k).alias("regions")))
    store.put(s.store.withColumn("samples", samples))
    store.lookup(s.files)
    found = store.fingerprints.read().select(*stores.KEY).withColumn("hit", F.lit(True))  # as the store is afterwards
    return s.files.join(found, stores.KEY, "left").select("item_id", F.coalesce("hit", F.lit(False)).alias("hit"))


@query("""select path, size_bytes, case when item_id % 2 = 0 then 2 else 1 end as written_at from items where item_id % 3 = 0 or item_id % 2 = 0""")
def fingerprint_store_upsert(s):
    """Two commits, and a writer that dies before its commit between them; the table is read again from its log."""
    store = _file_store(s)
    new = s.files.where("item_id % 2 = 0").drop("item_id").withColumn("written_at", F.lit(2))
    store.put(s.store)
    store.fingerprints._write(new.withColumns({"written_at": F.lit(3), "batch": F.lit(None).cast("long"), "_gone": F.lit(False)}), 1)
    store.put(new)
    return store.fingerprints.read().select("path", "size_bytes", "written_at")


@query("select item_id, 'cannot decode' as error, true as cached from items where item_id % 5 = 1")
def failure_store(s):
    store = _file_store(s)
    store.fail(s.failed)
    return s.files.join(store.failed(s.files), stores.KEY).select("item_id", "error", "cached")


@query("select item_id, sha256 from items")
def file_hash_store(s):
    """Half of the hashes are stored; the texts of the others only are read and hashed."""
    store, files = _file_store(s), s.items.select("item_id", "path", "size_bytes", "mtime_ns")
    store.hashes.append(s.items.where("item_id % 2 = 0").select("path", "size_bytes", "mtime_ns", "sha256"))
    texts = s.docs.select(F.col("doc_id").alias("mtime_ns"), F.col("text").cast("binary").alias("content"))
    return store.hashed(files, lambda asked: texts.join(asked, "mtime_ns").select("path", "content")).select("item_id", "sha256")


@query("select item_id, case when item_id % 3 = 0 then 'hit' when item_id % 5 = 1 then 'failed' else 'pending' end as status from items")
def incremental_split(s):
    store = _file_store(s)
    store.fail(s.failed)
    store.fingerprints.append(s.store)
    return store.split(s.files).select("item_id", "status")


@query("""select user_id::varchar as run_id, case when max(ts) filter (event_type = 'purchase') is null then 'interrupted' else 'completed' end as status, min(ts) filter (event_type = 'view') as started_at,
    max(ts) filter (event_type = 'purchase') as finished_at from events where event_type in ('view', 'purchase') group by user_id""")
def run_history(s):
    """Users as runs that begin with a view and end with a purchase, over two commits of the log."""
    log = RunLog(s.spark, f"{shared_dir(s.spark)}/runs-{s.spark.sparkContext.applicationId}-{uuid.uuid4().hex}")
    kind = F.when(F.col("event_type") == "view", "started").when(F.col("event_type") == "purchase", "completed")
    rows = adapters.read(s.spark, s.sf_dir, "events").select(F.col("user_id").cast("string").alias("run_id"), kind.alias("event"), F.col("ts").alias("at"), "event_id").where("event is not null")
    for part in (0, 1):
        log.append(rows.where(F.col("event_id") % 2 == part))
    return log.history().select("run_id", "status", "started_at", "finished_at")


@query("select group_id, keeper_ids, removal_order, 'manual' as method from decided")
def decision_snapshots(s):
    state = stores.state_of(s.items, s.matches, min_coverage=P.min_coverage)
    saved = stores.save_snapshot(s.decided, "r", "1", state).unionByName(stores.save_snapshot(s.decided.where("group_id % 5 = 0"), "r", "2", "another"))
    return stores.snapshot(saved, "r", "1", state).select("group_id", F.array_sort("keeper_ids").alias("keeper_ids"), F.array_sort("removal_order").alias("removal_order"), "method")


@query("select match_id, a_id, b_id, greatest(a_duplicated_percent, b_duplicated_percent) as most from matches")
def sort_matches(s):
    return align.sort_matches(s.matches).select("match_id", "a_id", "b_id", F.greatest("a_duplicated_percent", "b_duplicated_percent").alias("most"))


@query("select match_id, kind, a_id, b_id from matches")
def write_report(s):
    path = f"{shared_dir(s.spark)}/report-{s.spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    reports.write_report(path, s.items, s.matches, {"interval": str(P.interval)})
    return reports.load_report(s.spark, path)[1].select("match_id", "kind", "a_id", "b_id")


@query("select item_id, path, size_bytes, duration_seconds from items")
def load_report(s):
    path = f"{shared_dir(s.spark)}/report-{s.spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    reports.write_report(path, s.items, s.matches, {"interval": str(P.interval)})
    return reports.load_report(s.spark, path)[0].select("item_id", "path", "size_bytes", "duration_seconds")


@query("""select g.group_id, 'manual' as method, g.keeper_ids as keepers, g.removal_order as removals, count(a.item_id) as n_actions, coalesce(sum(i.size_bytes), 0)::bigint as bytes
    from decided g left join actions a using (group_id) left join items i using (item_id) group by all""")
def write_plan(s):
    path = f"{shared_dir(s.spark)}/plan-{s.spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    reports.write_plan(path, s.decided, s.actions, s.items)
    decisions, actions = reports.load_plan(s.spark, path)
    own = actions.join(s.actions.select("item_id", "group_id"), "item_id").groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("b"))
    ids = lambda c: F.transform(c, lambda p: F.regexp_extract(p, r"doc(\d+)", 1).cast("long"))
    told = decisions.select("group_id", "method", ids("keeper_paths").alias("keepers"), ids("removal_paths").alias("removals"))
    return told.join(own, "group_id", "left").select("group_id", "method", "keepers", "removals", F.coalesce("n", F.lit(0)).alias("n_actions"), F.coalesce("b", F.lit(0)).alias("bytes"))


@query("select d.status, count(*) as n from actions join drift d using (item_id) group by d.status")
def apply_result_log(s):
    checked = plans.validate_plan(s.actions, s.decided, s.items, s.inventory, by_set=False)
    path = f"{shared_dir(s.spark)}/results-{s.spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    name = F.create_map(*[F.lit(x) for x in ("ready", "ok", "refused", "changed", "skipped", "missing")])
    stores.append_results(checked.select(F.lit("p1").alias("plan_id"), "item_id", name[F.col("status")].alias("status")), path)
    return s.spark.read.schema("item_id long, status string, plan_id string").parquet(path).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# Scalar functions

_BIT = "case when embedding[{k}] > embedding[{n}] then 1 else 0 end"
_HALVES = [range(0, 32), range(32, 63)]


@query("select vec_id, " + ", ".join("(" + " + ".join(f"{1 << (31 - i)} * ({_BIT.format(k=k + 1, n=k + 2)})::bigint" for i, k in enumerate(h)) + f")::bigint as {n}" for h, n in zip(_HALVES, ("high", "low"))) + " from embeddings")
def frame_dhash(s):
    d = K.vector_dhash(F.col("embedding"))
    return s.vectors.select("vec_id", F.shiftrightunsigned(d, 32).alias("high"), d.bitwiseAND(F.lit(0xFFFFFFFF)).alias("low"))


_MEAN = "list_sum(list_transform(embedding, lambda x: x::double)) / len(embedding)"


_ABOVE = "case when embedding[{k}]::double >= m then 1 else 0 end"
_WORDS = ", ".join("(" + " + ".join(f"{1 << (31 - i)} * ({_ABOVE.format(k=32 * h + i + 1)})::bigint" for i in range(32)) + f")::bigint as {n}" for h, n in enumerate(("high", "low")))


@query(f"select vec_id, round(m, 6) as average, {_WORDS} from (select vec_id, embedding, {_MEAN} as m from embeddings)")
def frame_ahash(s):
    v = F.col("embedding")
    h = K.vector_ahash(v)
    return s.vectors.select("vec_id", F.round(K.vector_average(v), 6).alias("average"), F.shiftrightunsigned(h, 32).alias("high"), h.bitwiseAND(F.lit(0xFFFFFFFF)).alias("low"))


@query(f"select vec_id, least(255, greatest(0, floor(({_MEAN} + 1) * 127.5)))::int as mean from embeddings")
def frame_mean(s):
    return s.vectors.select("vec_id", K.vector_mean(F.col("embedding")).alias("mean"))


@query()
def regional_fingerprint(s):
    rows = pixels.frame_samples(s.frames)
    return rows.select("item_id", "pos", "dhash", "ahash", "mean", F.size("regions").alias("n_regions"), F.xxhash64("regions").alias("regions"))


@query(f"select item_id, count(*) as n, count(*) filter (not {_FLAT}) as informative from samples group by item_id")
def informative(s):
    return s.samples.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(K.informative(F.col("dhash"), F.col("ahash"))).alias("informative"))


@query(f"select item_id, pos, list_sort({_TOKENS}) as tokens from samples")
def sample_tokens(s):
    return s.samples.select("item_id", "pos", F.array_sort(K.sample_tokens(F.col("dhash"), F.col("ahash"))).alias("tokens"))


@query("select item_id, token, (h >> 32)::bigint as high, (h & 4294967295)::bigint as low from mixed")
def splitmix64(s):
    h = s.tokens.withColumn("h", K.splitmix64(F.col("token").cast("long")))
    return h.select("item_id", "token", F.shiftrightunsigned("h", 32).alias("high"), F.col("h").bitwiseAND(F.lit(0xFFFFFFFF)).alias("low"))


@query(f"select x.item_id, x.pos, ({_DISTANCE})::int as distance from samples x join samples y on y.item_id = x.item_id and y.pos = x.pos + 1")
def whole_distance(s):
    y = s.kept_samples.select("item_id", (F.col("pos") - 1).alias("pos"), F.col("dhash").alias("d"), F.col("ahash").alias("a"), F.col("mean").alias("m"))
    d = K.whole_distance(F.col("dhash"), F.col("ahash"), F.col("mean"), F.col("d"), F.col("a"), F.col("m"))
    return s.kept_samples.join(y, ["item_id", "pos"]).select("item_id", "pos", d.cast("int").alias("distance"))


@query()
def regional_distance(s):
    rows = pixels.frame_samples(s.frames).select("item_id", "pos", F.struct("dhash", "ahash", "mean", "regions").alias("x"))
    after = rows.select("item_id", (F.col("pos") - 1).alias("pos"), F.col("x").alias("y"))
    return rows.join(after, ["item_id", "pos"]).select("item_id", "pos", K.sample_distance("x", "y").cast("int").alias("distance"))


@query("""select event_id, case when v is null or isnan(v) or isinf(v) then 0.0 else v end as number from (select event_id, try_cast(case when event_id % 5 = 0 then event_type when event_id % 7 = 0 then 'NaN' when event_id % 11 = 0 then 'Infinity' else value::varchar end as double) as v from events)""")
def safe_float(s):
    e = adapters.read(s.spark, s.sf_dir, "events")
    text = F.when(F.col("event_id") % 5 == 0, F.col("event_type")).when(F.col("event_id") % 7 == 0, "NaN").when(F.col("event_id") % 11 == 0, "Infinity").otherwise(F.col("value").cast("string"))
    return e.select("event_id", K.safe_float(text).alias("number"))


@query("""select item_id, case when path like '/src1/en/%' then 0 when path like '/src1/%' then 1 when path like '/src2/%' then 1 else 2 end as depth from items""")
def relative_folder_depth(s):
    return s.items.select("item_id", K.relative_folder_depth(F.col("path"), F.array(F.lit("/src1"), F.lit("/src1/en"), F.lit("/src2/"))).alias("depth"))


@query("select page_id, regexp_matches(n, '\\p{L}') and regexp_matches(n, '\\p{Nd}') as mixed from (select page_id, regexp_replace(string_split(url, '/')[-1], '(.)\\.[^.]*$', '\\1') as n from pages)")
def mixed_alphanumeric_name(s):
    return adapters.read(s.spark, s.sf_dir, "pages").select("page_id", K.mixed_alphanumeric_name(F.col("url")).alias("mixed"))


@query("select item_id, row_number() over (order by width * height, size_bytes, duration_seconds, path) as place from items")
def quality_key(s):
    key = K.quality_key(F.col("width"), F.col("height"), F.col("size_bytes"), F.col("duration_seconds"), F.col("path"))
    return groups.numbered(s.items.withColumn("key", key), ["key"], "place").select("item_id", "place")


@query("select item_id, path, size_bytes, round(duration_seconds, 3) as duration_seconds, width, height, codec, sha256, detailed_sample_count from items")
def item_public(s):
    return reports.item_public(s.items)


# Filters


@query("select item_id from items where duration_seconds >= 3")
def min_duration_filter(s):
    return filters.min_duration(s.items, P.min_duration).select("item_id")


@query("select match_id from matches where a_id in (select item_id from items where duration_seconds >= 20) and b_id in (select item_id from items where duration_seconds >= 20)")
def filter_short_items(s):
    return filters.short_items_out(s.items, s.matches, 20.0)[1].select("match_id")


@query("select match_id from matches where greatest(a_duplicated_percent, b_duplicated_percent) + 1e-9 >= 95")
def min_duplicate_percent_filter(s):
    return filters.min_duplicate_percent(s.matches, 95.0, PERCENT).select("match_id")


@query("select item_id, pos from usable")
def drop_uninformative(s):
    return tokens.drop_uninformative(s.samples).select("item_id", "pos")


@query("select item_id, token from rare")
def drop_frequent_tokens(s):
    return s.rare.select("item_id", "token")


@query("select a, b, score from shared")
def min_shared_filter(s):
    return candidates.counts_of_lists(s.lists, P.max_frequency, P.min_shared)


@query("select a, b, i, j, distance from fast_points where distance <= 20")
def distance_filter(s):
    return verify.near_points(s.candidates, s.fast, P.distance)


@query("select distinct group_id from members join items using (item_id) where group_id % 2 = 1 and (contains(lower(path), 'src1/') or contains(group_id::varchar, 'src1/'))")
def group_search(s):
    return groups.group_search(s.members, s.items, s.decided, "decided", "SRC1/")


# Joins


@query("select item_id from items where size_bytes in (select size_bytes from items group by size_bytes having count(*) > 1)")
def same_size_suspects(s):
    return exact.same_size_suspects(s.items).select("item_id")


@query("select size_bytes, sha256, anchor, n from exact_sets")
def exact_groups(s):
    return exact.exact_groups(s.suspects)


@query("select a_id, b_id, kind, overlap_seconds, a_duplicated_percent, b_duplicated_percent, confidence from star")
def exact_matches(s):
    return exact.exact_matches(s.suspects).drop("a_sample_ranges", "b_sample_ranges")


@query("select a, b from capped semi join exact_pairs using (a, b)")
def exact_pair_keys(s):
    return exact.exact_pair_keys(s.suspects, s.capped)


@query("select a, b from capped")
def candidate_pairs(s):
    return s.capped


@query("select a, b from likely")
def verify_candidates(s):
    return s.likely


@query("select a, b, i, j, distance from points")
def matching_points(s):
    return s.points


@query("select match_id from matches")
def reject_unknown_refs(s):
    return groups.reject_unknown_refs(s.items, s.matches).select("match_id")


@query("select item_id, status from drift")
def drift_check(s):
    return plans.drift_check(s.items.select("item_id", "size_bytes", "mtime_ns"), s.inventory)


@query("select group_id, list_sort(keeper_ids) as keeper_ids, list_sort(removal_order) as removal_order, 'edited:manual' as method from decided")
def plan_rematch(s):
    rows = reports.plan_rows(s.decided, s.items)
    stored = rows.select("method", F.concat("keeper_paths", "removal_paths").alias("group_paths"), "keeper_paths", "removal_paths")
    return plans.plan_rematch(stored, s.members, s.items).select("group_id", "keeper_ids", F.array_sort("removal_order").alias("removal_order"), "method")


# Aggregations


@query("select a, b, score from scores")
def shared_token_counts(s):
    return s.scores


@query("select token, n from frequency")
def token_frequencies(s):
    return tokens.token_frequencies(s.selected)


@query("select a, b, bucket, n_left, n_right from support")
def bucket_support(s):
    return verify.near_support(s.candidates, s.fast, P.distance)


@query("select a, b, shift, votes from offset_counts")
def offset_votes(s):
    return align.offset_votes(s.points)


@query("select a, b, round(sure, 9) as sure from paired")
def match_confidence(s):
    return s.aligned.groupBy("a", "b").agg(F.round(align.match_confidence("distance", P.distance), 9).alias("sure"))


@query("""select (select count(*) from items where duration_seconds >= 3) as scanned, (select count(*) from items where duration_seconds < 3) as short_filtered, (select count(*) from candidates) as candidate_pairs,
    (select count(*) from likely) as verified_pairs, (select count(*) from matches) as duplicate_pairs""")
def scan_summary(s):
    return reports.scan_summary(filters.min_duration(s.items, P.min_duration), s.items.where(F.col("duration_seconds") < P.min_duration), s.candidates, s.likely, s.matches)


@query("""select (select count(distinct group_id) from members) as groups, (select count(distinct item_id) from members) as grouped_items, (select count(distinct match_id) from used) as matches,
    (select count(*) from decided) as decided, (select sum(size_bytes)::bigint from items where item_id in (select item_id from members)) as total_bytes""")
def session_summary(s):
    return reports.session_summary(s.members, s.used, s.items, s.decided)


@query("select group_id, n_items, coalesce(n_matches, 0) as n_matches from (select group_id, count(*) as n_items from members group by group_id) left join (select group_id, count(*) as n_matches from used group by group_id) using (group_id)")
def group_summary(s):
    return groups.group_summary(s.members, s.used)


@query("select coalesce(sum(size_bytes), 0)::bigint as bytes from items where item_id in (select item_id from actions)")
def reclaim_bytes(s):
    return plans.reclaim_bytes(s.actions, s.items)


_PAIR = """pair as (select u.group_id, b.item_id, b.other_id, case when bool_or(b.kind = 'exact') then 100.0 else least(100.0, 100.0 * count(distinct bin) / n) end + 1e-9 as c
    from bins b join used u using (match_id) join item_n using (item_id) group by u.group_id, b.item_id, b.other_id, n)"""


@query("select m.group_id, m.item_id, count(p.item_id) as contained from members m left join (select x.group_id, x.item_id, x.other_id from (" + _PAIR[9:-1] + ") x join (" + _PAIR[9:-1] + ") y on x.group_id = y.group_id and x.item_id = y.other_id and x.other_id = y.item_id where x.c >= 95 and y.c < 95) p on p.group_id = m.group_id and p.other_id = m.item_id group by all")
def contained_counts(s):
    return policy.contained_counts(s.members, s.used, s.matches, s.items, P.interval, P.min_coverage)


@query("select group_id from decided where len(removal_order) > 0")
def actionable_sets(s):
    return plans.actionable_sets(s.members, s.decided)


@query("select item_id, sum(\"end\" - \"start\" + 1)::double as seconds from user_ranges group by item_id")
def duplicated_seconds(s):
    return coverage.duplicated_seconds(s.user_ranges.select("item_id", F.col("start").cast("double").alias("start_seconds"), (F.col("end") + 1).cast("double").alias("end_seconds")))


# Windows and top-k


@query("select item_id, token from selected")
def selected_tokens(s):
    return s.selected


@query("select a, b from capped")
def cap_candidates(s):
    return candidates.best_of_lists(s.lists, P.max_frequency, P.min_shared, P.per_item)


@query("select a, b, shift, votes, place from ranked_offsets where place <= 20")
def top_offsets(s):
    return align.top_offsets(align.offset_votes(s.points), P.top_offsets)


@query("select a, b, shift, i, j, distance from chosen")
def aligned_choice(s):
    return align.aligned_choice(s.points, align.top_offsets(align.offset_votes(s.points), 1))


@query("select item_id, bin, sum(new) over (partition by item_id order by bin rows unbounded preceding)::int as run from (select *, case when bin - lag(bin) over (partition by item_id order by bin) <= 2 then 0 else 1 end as new from user_bins)")
def runs(s):
    return align.runs(s.user_bins, ["item_id"], "bin")


@query("select a, b, i, j from (select *, max(j) over (partition by a, b, run order by i rows between unbounded preceding and 1 preceding) as top from run_numbers) where top is null or j > top")
def monotonic_filter(s):
    chosen = align.aligned_choice(s.points, align.top_offsets(align.offset_votes(s.points), 1))
    return align.monotonic(align.runs(chosen, ["a", "b"]), ["a", "b", "run"]).select("a", "b", "i", "j")


@query(f"select a, b, i, j, distance from taken_{P.top_offsets}")
def align_pairs(s):
    return s.aligned


@query("select a, b, i, j, distance from aligned")
def align_best_offset(s):
    return align.align_best_offset(s.points, P)


def _told(c: str) -> str:
    return f"list_aggregate(list_transform({c}, lambda r: r['start'] || '-' || r['end']), 'string_agg', ' ')"


@query(f"select a_id, b_id, overlap_seconds, a_duplicated_percent, b_duplicated_percent, confidence, {_told('a_sample_ranges')} as a_ranges, {_told('b_sample_ranges')} as b_ranges from records")
def match_records(s):
    told = lambda c: F.array_join(F.transform(c, lambda r: F.concat(r["start"], F.lit("-"), r["end"])), " ")
    return s.records.select("a_id", "b_id", "overlap_seconds", "a_duplicated_percent", "b_duplicated_percent", "confidence", told("a_sample_ranges").alias("a_ranges"), told("b_sample_ranges").alias("b_ranges"))


@query("select group_id, members[1] as least, len(members) as n from set_ids")
def number_groups(s):
    return s.members.groupBy("group_id").agg(F.min("item_id").alias("least"), F.count(F.lit(1)).alias("n"))


@query("select group_id, item_id, place from (select group_id, item_id, row_number() over (partition by group_id order by size_bytes desc, path) as place from named) where place <= 2")
def top_members(s):
    rows = s.members.join(s.items.select("item_id", "size_bytes", "path"), "item_id")
    return groups.top_members(rows, [F.col("size_bytes").desc(), F.col("path")], 2)


# Coverage and ranges


@query('select item_id, "start", "end" from user_ranges')
def compress_ranges(s):
    return s.user_ranges


@query("select item_id, bin from user_bins")
def expand_ranges(s):
    return coverage.expand_ranges(s.user_ranges, ["item_id"])


@query("""select item_id, case when min("start") <= 1 then 0 else min("start") end as "start", case when max("end") >= 718 then 719 else max("end") end as "end" from
    (select *, sum(new) over (partition by item_id order by "start" rows unbounded preceding) as run from (select *, case when "start" - lag("end") over (partition by item_id order by "start") <= 2 then 0 else 1 end as new from user_ranges))
    group by item_id, run""")
def normalize_coverage(s):
    return coverage.normalize_coverage(s.user_ranges.withColumn("n", F.lit(720)), ["item_id"])


@query("select match_id, item_id, count(*) as n, min(bin) as first, max(bin) as last from bins group by all")
def relation_bins(s):
    bins = coverage.relation_bins(s.matches, coverage.item_counts(s.items, P.interval))
    return bins.groupBy("match_id", "item_id").agg(F.count(F.lit(1)).alias("n"), F.min("bin").alias("first"), F.max("bin").alias("last"))


@query("select item_id, covered_percent, sources, n_sources from (select group_id, item_id, round(covered_percent, 6) as covered_percent, sources, n_sources from covered where group_id = (select min(group_id) from members m where m.item_id = covered.item_id))")
def covered_by(s):
    own = s.members.groupBy("item_id").agg(F.min("group_id").alias("scope"))
    found = coverage.covered_by(own.select("scope", "item_id"), s.members.select(F.col("group_id").alias("scope"), "item_id"), s.matches, s.items, P.interval, s.classes)
    return found.select("item_id", F.round("covered_percent", 6).alias("covered_percent"), "sources", "n_sources")


@query("select item_id, n from item_n")
def sample_count(s):
    return coverage.item_counts(s.items, P.interval)


@query("""select item_id, "start"::double as start_seconds, least(duration_seconds, "end" + 1) as end_seconds from (select item_id, min(bin) as "start", max(bin) as "end" from
    (select item_id, bin, bin - row_number() over (partition by item_id order by bin) as island from (select distinct item_id, bin from bins)) group by item_id, island) join items using (item_id) where "start" < duration_seconds""")
def duplicate_time_ranges(s):
    return coverage.duplicate_time_ranges(s.matches, s.items, P.interval)


@query("select group_id, item_id, round(covered_percent, 6) as covered_percent, sources, n_sources from covered")
def group_coverage(s):
    return groups.group_coverage(s.members, s.used, s.matches, s.items, P.interval).withColumn("covered_percent", F.round("covered_percent", 6))


# Graphs


@query("select item_id, class_id from classes")
def exact_classes(s):
    return s.classes


@query("select match_id, component from clips")
def clip_components(s):
    return s.clips


@query("select component, item_id from clip_members")
def expand_aliases(s):
    return groups.expand_aliases(s.matches, s.classes, s.clips)[0]


@query("select group_id, item_id from members")
def merge_equal_groups(s):
    return s.members


@query("select class_id, item_id from alone")
def exact_only_groups(s):
    return groups.exact_only(s.matches, s.classes)


@query("select m.group_id, m.item_id, (select count(*) from used u where u.group_id = m.group_id) as n_matches from members m")
def duplicate_groups(s):
    n = s.used.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_matches"))
    return s.members.join(n, "group_id", "left").select("group_id", "item_id", F.coalesce("n_matches", F.lit(0)).alias("n_matches"))


@query("select group_id, match_id from used")
def group_matches(s):
    return s.used


def _links() -> str:
    from strandfold import oracle

    oracle.CTES["group_links"] = "select distinct x.group_id as a, y.group_id as b from members x join members y using (item_id)"
    oracle.CTES["group_reach"] = "@select a, b from group_links union select r.a, e.b from group_reach r join group_links e on e.a = r.b"
    return "select distinct b as group_id from group_reach where a % 3 = 0"


@query(_links())
def linked_groups(s):
    return groups.linked_groups(s.members, s.members.where("group_id % 3 = 0").select("group_id").distinct())


# Sets


@query("select kind, count(*) as n, sum(a_id)::bigint as a, sum(b_id)::bigint as b from all_matches group by kind")
def all_matches(s):
    return exact.exact_matches(s.suspects).unionByName(s.records).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("a_id").alias("a"), F.sum("b_id").alias("b"))


@query("select a, b from candidates")
def candidates_without_exact(s):
    return s.candidates


@query("select a as item_id from likely union select b from likely")
def likely_items(s):
    return candidates.likely_items(s.likely)


@query("""select item_id, case when own and item_id < others[1] then others[-1] else others[1] end as keeper, len(others)::bigint as n_keepers from (select w.item_id, w.item_id in (select item_id from kept) as own, list_sort(list(k.item_id)) as others
    from classes w join classes k using (class_id) join kept on kept.item_id = k.item_id where k.item_id <> w.item_id and w.item_id in (select item_id from members) group by w.item_id)""")
def exact_keepers(s):
    scope = F.lit(0).alias("scope")
    found = coverage.exact_sources(s.members.select(scope, "item_id").distinct(), plans.keepers(s.decided).select(scope, "item_id"), s.classes)
    return found.select("item_id", F.col("source").alias("keeper"), F.col("n_sources").alias("n_keepers"))


# Policy and plans


@query("select group_id, item_id, place from prior")
def removal_priority(s):
    return s.prior


@query("select group_id, gone as item_id, (row_number() over (partition by group_id order by k))::int as place from walk_fully where gone is not null")
def recommend_removals(s):
    return policy.recommend_removals(s.members, s.used, s.matches, s.items, "delete-fully-covered", P.interval, P.min_coverage)


@query("""select group_id, list_sort(list(item_id) filter (item_id not in (select gone from walk_prior w where w.group_id = members.group_id and gone is not null))) as keeper_ids,
    coalesce((select list(gone order by k) from walk_prior w where w.group_id = members.group_id and gone is not null), []) as removal_order, 'strategy:delete-shorter-name' as method from members group by group_id""")
def strategy_decisions(s):
    gone = policy.recommend_removals(s.members, s.used, s.matches, s.items, "delete-shorter-name", P.interval, P.min_coverage)
    return policy.strategy_decisions(s.members, gone, "strategy:delete-shorter-name")


@query("select item_id, group_id, place, covered_percent, sources, n_sources from actions")
def build_actions(s):
    return s.actions


@query("""select m.group_id, coalesce(list_sort(list(m.item_id) filter (m.item_id not in (select item_id from asked))), []) as keeper_ids, 'web-unresolved-kept' as method from members m where group_id not in (select group_id from decided) group by m.group_id
    union all select group_id, keeper_ids, 'manual' from decided""")
def default_decisions(s):
    return plans.default_decisions(s.members, s.decided).select("group_id", "keeper_ids", "method")


@query(f"select m.group_id, m.item_id, coalesce(l.keep, true) as keep from members m left join (select item_id, arg_max(keep, seq) as keep from ({_LOG[8:-1]}) group by item_id) l using (item_id) where m.group_id in (select group_id from ({_LOG[8:-1]}))")
def sync_shared_choices(s):
    return plans.sync_shared_choices(s.members, s.log)


@query(f"select item_id from (select m.group_id, m.item_id, coalesce(l.keep, true) as keep from members m left join (select item_id, arg_max(keep, seq) as keep from ({_LOG[8:-1]}) group by item_id) l using (item_id) where m.group_id in (select group_id from ({_LOG[8:-1]}))) group by item_id having not bool_or(keep)")
def removal_files(s):
    return plans.removal_files(plans.sync_shared_choices(s.members, s.log))


@query("""select group_id, list_sort(list(item_id) filter (not gone)) as keeper_ids, list(item_id order by place, item_id) filter (gone) as removal_order from
    (select group_id, item_id, item_id in (select item_id from actions) as gone, (select a.place from actions a where a.item_id = members.item_id) as place from members) group by group_id having bool_or(gone) and not bool_and(gone)""")
def infer_legacy_decisions(s):
    return plans.infer_legacy_decisions(s.members, s.actions.select("place", "item_id")).drop("method")


@query("""select item_id, group_id, case when max(case when status = 'changed' then 1 else 0 end) over (partition by group_id) = 1 then 'refused' when status = 'missing' then 'skipped' else 'ready' end as status
    from (select a.item_id, (select min(group_id) from asked k where k.item_id = a.item_id) as group_id, d.status from actions a join drift d using (item_id))""")
def validate_plan(s):
    return plans.validate_plan(s.actions, s.decided, s.items, s.inventory)


@query("select group_id, item_id from members_left")
def retire_resolved(s):
    done = s.actions.where("item_id % 2 = 0").select("item_id")
    return plans.retire_resolved(s.items, s.matches, s.members, s.decided, done)[2]


# Streaming


def _stream(s) -> tuple[DataFrame, str]:
    base = f"{shared_dir(s.spark)}/stream-{s.spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    s.docs.select("doc_id", "text").withColumn("part", F.col("doc_id") % 4).repartition(4, "part").drop("part").write.parquet(f"{base}/in")
    return s.spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(f"{base}/in"), base


def _text_files(rows: DataFrame) -> DataFrame:
    """The store's key of arriving documents."""
    path = F.concat(F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return rows.withColumns({"path": path, "size_bytes": F.octet_length("text").cast("long"), "mtime_ns": F.col("doc_id"), "kind": F.lit("fast"), "interval": F.lit(P.interval)})


@query("select item_id, pos, mean from samples")
def stream_fingerprints(s):
    stream, base = _stream(s)
    incremental.stream_fingerprints(stream, adapters.document_samples, f"{base}/store", f"{base}/checkpoint", P, files=_text_files).awaitTermination()
    return incremental.current(s.spark, f"{base}/store", "samples").select("item_id", "pos", F.col("mean").cast("int").alias("mean"))


@query()
def stream_match_new(s):
    stream, base = _stream(s)
    incremental.stream_match_new(s.spark, stream, adapters.document_samples, f"{base}/store", f"{base}/checkpoint", P, files=_text_files).awaitTermination()
    return incremental.current_matches(s.spark, f"{base}/store").select("a", "b", "i", "j", "distance")
