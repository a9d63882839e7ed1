"""The query catalogue: every operator applied to the driver's tables, with its SQL twin.

Frames come from the tables in these ways: orders with their line items as atoms,
conversations with their turns, users with their events; and extended-XYZ text that is
written from rows and read back by the grammar.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticelake.functions import elements, text
from latticelake.operators import batch, infer, match, project, stats, targets
from latticelake.operators.select import numbered, running, select
from latticelake.plans.spec import ColumnRule, FrameRule, MetadataRule, SchemaSpec
from latticelake.session import ship
from latticelake.types import COLUMN, ENTRY, Kind

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Line items in the order of a frame's atoms: the six columns that make it total.
ITEM_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# frames from tables

_OL = "ol as (select o_orderkey, count(l_orderkey) n, row_number() over (order by o_orderkey) - 1 fi from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey)"
_CV = "cv as (select conv_id, count(*) n, bool_or(role = 'system') sys, row_number() over (order by conv_id) - 1 fi from conversations group by conv_id)"
_EV = "ev as (select user_id, count(*) n, row_number() over (order by user_id) - 1 fi from events group by user_id)"


def orders_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, n_atoms, frame_index): an order is a frame, its line items are atoms; an order without any has none."""
    items = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey")
    return numbered(orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_atoms")), "o_orderkey")


def users_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n_atoms")), "user_id")


def talks_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "conversations").groupBy("conv_id")
    return numbered(own.agg(F.count("*").alias("n_atoms"), F.bool_or(F.col("role") == "system").alias("sys"), F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")), "conv_id")


def tagged(name: str, kind: Column | str, extent: Column, r: Column | None = None, i: Column | None = None, b: Column | None = None, s: Column | None = None, column: bool = True) -> Column:
    """An entry of the canonical schema."""
    none = F.lit(None)
    put = [(none if v is None else v).cast(f"array<{t}>").alias(n) for n, t, v in (("r", "double", r), ("i", "bigint", i), ("b", "boolean", b), ("s", "string", s))]
    kind = kind if isinstance(kind, Column) else F.lit(kind)
    return F.struct(F.lit(name).alias("name" if column else "key"), kind.alias("kind"), extent.alias("width" if column else "shape"), *put)


def talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as frames whose make-up varies with the id: optional, drifting and repeated entries."""
    c, n = F.col("conv_id"), F.col("n_atoms")
    sizes = F.transform("turns", lambda t: F.length(t["text"]).cast("bigint"))
    real = c % 4 == 3
    width = F.when(c % 6 == 0, 2).otherwise(3)
    extra = F.transform(F.sequence(F.lit(1), (n * width).cast("int")), lambda k: k.cast("double"))
    none_col, none_meta = F.array().cast(f"array<{COLUMN}>"), F.array().cast(f"array<{ENTRY}>")
    columns = F.concat(
        F.array(tagged("role", "S", F.lit(1), s=F.transform("turns", lambda t: t["role"])), tagged("len", F.when(real, "R").otherwise("I"), F.lit(1), r=F.when(real, sizes.cast("array<double>")), i=F.when(~real, sizes))).cast(f"array<{COLUMN}>"),
        F.when(c % 3 == 0, F.array(tagged("extra", "R", width, r=extra)).cast(f"array<{COLUMN}>")).otherwise(none_col),
    )
    flat = F.array().cast("array<int>")
    one = lambda v: F.array(v)
    many = (n % 3 + 1).cast("int")
    metadata = F.concat(
        F.array(tagged("turns", "I", flat, i=one(n), column=False), tagged("tag", "S", flat, s=one(F.concat(F.lit("c"), c.cast("string"))), column=False)).cast(f"array<{ENTRY}>"),
        F.when(c % 5 == 0, F.array(tagged("tag", "I", flat, i=one(c), column=False)).cast(f"array<{ENTRY}>")).otherwise(none_meta),
        F.when(F.col("sys"), F.array(tagged("has_system", "L", flat, b=one(F.lit(True)), column=False)).cast(f"array<{ENTRY}>")).otherwise(none_meta),
        F.array(tagged("w", "R", F.array(many), r=F.array_repeat(F.lit(0.5), many), column=False), *(tagged(f"d{k}", "I", flat, i=one(c * k), column=False) for k in range(3))).cast(f"array<{ENTRY}>"),
        F.array(tagged("Lattice", "I", F.array(F.lit(9)), i=F.array(*(x.cast("bigint") for x in lattice(c))), column=False)).cast(f"array<{ENTRY}>"),
    )
    return talks_index(spark, sf_dir).select(F.lit("conversations").alias("source"), "frame_index", F.lit(0).cast("bigint").alias("offset"), (F.col("frame_index") * 10 + 1).alias("line"), "n_atoms", columns.alias("columns"), metadata.alias("metadata"), "conv_id")


def lattice(k: Column) -> list[Column]:
    """Nine integers made from an id."""
    return [k % 7 + 10, k % 3, k % 2, k % 5, k % 11 + 10, k % 4, k % 2, k % 3, k % 13 + 10]


_L = ["({0} % 7 + 10)", "({0} % 3)", "({0} % 2)", "({0} % 5)", "({0} % 11 + 10)", "({0} % 4)", "({0} % 2)", "({0} % 3)", "({0} % 13 + 10)"]


def _l(key: str) -> list[str]:
    return [x.format(key) for x in _L]


def _det(m: list[str]) -> str:
    a, b, c, d, e, f, g, h, i = m
    return f"abs({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


_COLS = """cols as (
  select fi, conv_id, n, 0 pos, 'role' as name, 'S' as kind, 1 as width from cv
  union all select fi, conv_id, n, 1, 'len', case when conv_id % 4 = 3 then 'R' else 'I' end, 1 from cv
  union all select fi, conv_id, n, 2, 'extra', 'R', case when conv_id % 6 = 0 then 2 else 3 end from cv where conv_id % 3 = 0)"""
_META = """meta as (
  select fi, conv_id, 0 pos, 'turns' as key, 'I' as kind, '' as shape from cv
  union all select fi, conv_id, 2, 'tag', case when conv_id % 5 = 0 then 'I' else 'S' end, '' from cv
  union all select fi, conv_id, 3, 'has_system', 'L', '' from cv where sys
  union all select fi, conv_id, 4, 'w', 'R', (n % 3 + 1)::varchar from cv
  union all select fi, conv_id, 5, 'd0', 'I', '' from cv union all select fi, conv_id, 6, 'd1', 'I', '' from cv union all select fi, conv_id, 7, 'd2', 'I', '' from cv
  union all select fi, conv_id, 8, 'Lattice', 'I', '9' from cv)"""


# A: scans and selection


@query(f"with {_OL} select o_orderkey, fi::bigint frame_index, n n_atoms, (sum(n) over (order by fi) - n)::bigint atom_offset from ol")
def scan_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return running(orders_index(spark, sf_dir), "n_atoms", "atom_offset", "frame_index").select("o_orderkey", "frame_index", "n_atoms", "atom_offset")


@query(f"with {_EV} select user_id, {_det(_l('user_id'))}::double volume from ev")
def scan_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return users_index(spark, sf_dir).select("user_id", stats.volume(F.array(*lattice(F.col("user_id")))).alias("volume"))


@query("""with n as (select count(l_orderkey) n from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey)
  select count(*) n_frames, sum(n)::bigint total_atoms, min(n) min_atoms, max(n) max_atoms, round(avg(n), 9) mean_atoms, median(n) median_atoms, round(stddev_pop(n), 9) std_atoms from n""")
def atom_count_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    frames = read(spark, sf_dir, "orders").select("o_orderkey").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.coalesce("n", F.lit(0)).cast("bigint").alias("n_atoms"))
    return stats.atom_stats(frames).withColumns({c: F.round(c, 9) for c in ("mean_atoms", "std_atoms")})


@query(f"with {_CV} select fi::bigint frame_index, ((fi - 10) / 7)::bigint pos, conv_id from cv where fi >= 10 and fi < 90 and (fi - 10) % 7 = 0")
def select_slice_fwd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(talks_index(spark, sf_dir), "10:90:7").select("frame_index", "pos", "conv_id")


@query(f"with {_CV}, t as (select count(*) n from cv) select fi::bigint frame_index, (fi - greatest(t.n - 20, 0))::bigint pos, conv_id from cv, t where fi >= t.n - 20 and fi < t.n - 5")
def select_slice_neg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(talks_index(spark, sf_dir), "-20:-5").select("frame_index", "pos", "conv_id")


@query(f"with {_CV}, t as (select count(*) n from cv) select fi::bigint frame_index, ((t.n - 1 - fi) / 3)::bigint pos, conv_id from cv, t where (t.n - 1 - fi) % 3 = 0")
def select_slice_reversed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(talks_index(spark, sf_dir), "::-3").select("frame_index", "pos", "conv_id")


@query(f"with {_CV} select pos::bigint pos, fi::bigint frame_index, conv_id from (values (0, 5), (1, 2), (2, 5), (3, 40), (4, 0)) a(pos, i) join cv on fi = i")
def select_list_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(talks_index(spark, sf_dir), [5, 2, 5, 40, 0]).select("pos", "frame_index", "conv_id")


@query(f"with {_OL} select o_orderkey, n n_atoms from ol where fi = 0")
def select_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(orders_index(spark, sf_dir), 0).select("o_orderkey", "n_atoms")


@query(f"with {_OL} select o_orderkey, n n_atoms from ol where fi = (select max(fi) from ol)")
def select_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(orders_index(spark, sf_dir), -1).select("o_orderkey", "n_atoms")


@query(f"with {_OL} select fi::bigint frame_index, n n_atoms from ol where fi % 900 = 0")
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(orders_index(spark, sf_dir), "::900").select("frame_index", "n_atoms")


# B: grammar


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, line): a comment line for each customer, with bare, quoted and bracketed values."""
    k, n, s = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string"), F.col("c_mktsegment")
    line = F.concat(F.lit("Properties=species:S:1:pos:R:3 key="), k, F.lit(' name="'), F.col("c_name"), F.lit(" of "), s, F.lit('" tags=['), s, F.lit(", "), n, F.lit("] m=[["), k, F.lit(","), n, F.lit("],[1,2]] seg="), s)
    return read(spark, sf_dir, "customer").select("c_custkey", line.alias("line"))


@query("""select c_custkey, 0::int pos, 'Properties' as key, 'species:S:1:pos:R:3' as raw from customer
  union all select c_custkey, 1, 'key', c_custkey::varchar from customer union all select c_custkey, 2, 'name', '"' || c_name || ' of ' || c_mktsegment || '"' from customer
  union all select c_custkey, 3, 'tags', '[' || c_mktsegment || ', ' || c_nationkey || ']' from customer
  union all select c_custkey, 4, 'm', '[[' || c_custkey || ',' || c_nationkey || '],[1,2]]' from customer union all select c_custkey, 5, 'seg', c_mktsegment from customer""")
def parse_comment_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.tokens(comments(spark, sf_dir), "line", "c_custkey").select("c_custkey", "pos", "key", "raw")


@query("""select c_custkey, key, kind, shape from customer, (values ('key', 'I', ''), ('m', 'I', '2,2'), ('name', 'S', ''), ('seg', 'S', ''), ('tags', 'S', '2')) t(key, kind, shape)""")
def parse_comment_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = text.tokens(comments(spark, sf_dir), "line", "c_custkey").where("key <> 'Properties'")
    return text.typed(pairs, "raw", "c_custkey", "key").select("c_custkey", "key", "kind", F.array_join(F.col("shape").cast("array<string>"), ",").alias("shape"))


#: Tokens that tell the kinds apart, beside those of the tables.
TOKENS = ["1", "-1", "+12", "012", "9223372036854775807", "9223372036854775808", "1.", ".012", "012.0", "-12.0e2", "-12.0D+02", "1e5", "1d3", "nan", "inf", "t", "T", "true", "True", "TRUE", "TRuE", "f", "False", "1.3k7", "-2.75e", "+2.75e-", "'abc'", "0x1", "1_0", "."]
_KIND_SQL = """case when regexp_full_match(t, '[+-]?[0-9]+') and try_cast(t as bigint) is not null then 'I'
    when regexp_full_match(t, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eEdD][+-]?[0-9]+)?') and regexp_matches(t, '[.eEdD]') then 'R'
    when t in ('t', 'T', 'true', 'True', 'TRUE', 'f', 'F', 'false', 'False', 'FALSE') then 'L' else 'S' end"""
_TOKENS_SQL = "words as (select unnest(string_split(c_name || ' ' || c_mktsegment || ' ' || c_custkey || ' ' || c_nationkey || '.5', ' ')) t from customer union all select unnest([{}]))".format(", ".join("'" + t.replace("'", "''") + "'" for t in TOKENS))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    own = c.select(F.explode(F.split(F.concat_ws(" ", "c_name", "c_mktsegment", F.col("c_custkey").cast("string"), F.concat(F.col("c_nationkey").cast("string"), F.lit(".5"))), " ")).alias("t"))
    return own.union(spark.range(1).select(F.explode(F.array(*map(F.lit, TOKENS)))))


@query(f"with {_TOKENS_SQL} select t as token, {_KIND_SQL} kind, count(*) n from words group by all")
def parse_value_typing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).groupBy(F.col("t").alias("token"), text.kind_of(F.col("t")).alias("kind")).agg(F.count("*").alias("n"))


@query(f"with {_TOKENS_SQL} select {_KIND_SQL} kind, count(*) n from words group by all")
def parse_value_typer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.typed(words(spark, sf_dir), "t").groupBy("kind").agg(F.count("*").alias("n"))


@query("""select p_partkey, pos::int pos, name, kind, width::int width from (
  select p_partkey, 0 pos, 'species' as name, 'S' as kind, 1 as width from part union all select p_partkey, 1, 'pos', 'R', 3 from part
  union all select p_partkey, 2, 'd' || p_size, 'I', p_size from part union all select p_partkey, 3, 'on', 'L', 1 from part)""")
def parse_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    d = F.concat(F.lit("species:S:1:pos:R:3:d"), size, F.lit(":I:"), size, F.lit(":on:L:1"))
    return text.described(read(spark, sf_dir, "part").select("p_partkey", d.alias("d")), "d", "p_partkey")


def order_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, frame_index, text): each order with line items as the text of a frame."""
    items = read(spark, sf_dir, "lineitem")
    row = F.concat_ws(" ", F.col("l_returnflag"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.when(F.col("l_linestatus") == "O", "T").otherwise("F"))
    each = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*ITEM_ORDER, row.alias("row")))).alias("rows"))
    head = F.concat(F.size("rows").cast("string"), F.lit("\nProperties=species:S:1:line:I:1:ids:I:2:open:L:1 order="), F.col("l_orderkey").cast("string"), F.lit("\n"))
    return each.select(F.lit("orders").alias("source"), F.col("l_orderkey").alias("frame_index"), F.concat(head, F.array_join(F.transform("rows", lambda r: r["row"]), "\n"), F.lit("\n")).alias("text"))


_ITEMS = "items as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 as k from lineitem)"


@query(f"with {_ITEMS} select l_orderkey frame_index, k::int atom, l_returnflag species, l_linenumber::bigint line_no, l_partkey part, l_suppkey supp, l_linestatus = 'O' is_open from items")
def parse_atom_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = text.parsed(order_texts(spark, sf_dir))
    c = lambda k, s: F.col("columns")[k][s]
    zipped = F.transform(c(0, "s"), lambda v, i: F.struct(v.alias("species"), F.get(c(1, "i"), i).alias("line_no"), F.get(c(2, "i"), i * 2).alias("part"), F.get(c(2, "i"), i * 2 + 1).alias("supp"), F.get(c(3, "b"), i).alias("is_open")))
    return frames.select("frame_index", F.posexplode(zipped).alias("atom", "a")).select("frame_index", "atom", "a.*")


@query("""select o_orderkey, regexp_full_match(trim(t), '\\+?[0-9]+') valid from (
  select o_orderkey, case o_orderkey % 5 when 0 then o_orderkey::varchar when 1 then ' +' || o_orderkey || ' ' when 2 then '-' || o_orderkey when 3 then o_orderkey || '.0' else o_orderstatus end t from orders)""")
def count_lines_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey").cast("string")
    r = F.col("o_orderkey") % 5
    t = F.when(r == 0, k).when(r == 1, F.concat(F.lit(" +"), k, F.lit(" "))).when(r == 2, F.concat(F.lit("-"), k)).when(r == 3, F.concat(k, F.lit(".0"))).otherwise(F.col("o_orderstatus"))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.trim(t).rlike(r"^\+?[0-9]+$").alias("valid"))


# D: atoms and batches


@query("select user_id, (row_number() over (partition by user_id order by ts, event_id) - 1)::bigint atom_index, event_type, event_id from events")
def atoms_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return read(spark, sf_dir, "events").select("user_id", at.cast("bigint").alias("atom_index"), "event_type", "event_id")


@query(f"with {_OL} select fi::bigint frame_index, (fi // 64)::bigint batch_id, (fi % 64)::bigint pos_in_batch, n n_atoms, (sum(n) over (partition by fi // 64 order by fi) - n)::bigint atom_offset from ol")
def batch_csr_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.with_offsets(batch.fixed_plan(orders_index(spark, sf_dir), 64))


@query(f"with {_OL} select (fi // 64)::bigint batch_id, count(*) n_frames, sum(n)::bigint n_atoms from ol group by 1")
def batch_by_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.fixed_plan(orders_index(spark, sf_dir), 64).groupBy("batch_id").agg(F.count("*").alias("n_frames"), F.sum("n_atoms").alias("n_atoms"))


@query(f"""with recursive {_OL}, g as (
  select fi, 0::bigint b, n t from ol where fi = 0
  union all select ol.fi, case when g.t + ol.n > 64 then g.b + 1 else g.b end, case when g.t + ol.n > 64 then ol.n else g.t + ol.n end from g join ol on ol.fi = g.fi + 1)
  select fi::bigint frame_index, b batch_id from g""")
def batch_by_atoms_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.greedy_plan(orders_index(spark, sf_dir), 64).select("frame_index", "batch_id")


def _bfd(frames: str, weight: str, most: str) -> str:
    return f"""with recursive {frames}, w as (select fi, {weight} n, row_number() over (order by {weight} desc, fi) rn from {frames.split()[0]}), s as (
  select 0::bigint rn, null::bigint fi, null::bigint b, []::double[] sums
  union all select rn, fi, coalesce(c - 1, len(sums)) b, case when c is null then list_append(sums, n) else list_transform(sums, lambda x, i: case when i = c then x + n else x end) end
  from (select w.rn, w.fi, w.n, s.sums, list_position(s.sums, list_max(list_filter(s.sums, lambda x: x + w.n <= {most})))::bigint c from s join w on w.rn = s.rn + 1))
  select fi::bigint frame_index, b batch_id from s where fi is not null"""


@query(_bfd(_EV, "n::double", "200"))
def batch_bfd_n_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.memory_plan(users_index(spark, sf_dir), 200).select("frame_index", "batch_id")


@query(_bfd(_CV, "n::double", "16"))
def batch_bfd_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.memory_plan(talks_index(spark, sf_dir), 16).select("frame_index", "batch_id")


@query(f"with {_EV} select user_id, case when user_id % 10 = 0 or user_id % 10 - 3 <= 0 then n::double else n::double * n / (user_id % 10 - 3) end weight from ev")
def batch_density_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("user_id") % 10
    volume = F.when(k == 0, F.lit(float("nan"))).otherwise((k - 3).cast("double"))
    return users_index(spark, sf_dir).select("user_id", stats.density_weight(F.col("n_atoms"), volume).alias("weight"))


@query(f"with {_OL} select pos::bigint pos, fi::bigint frame_index, n n_atoms from (values (0, 7), (1, 3), (2, 7), (3, 11), (4, 0), (5, 3)) a(pos, i) join ol on fi = i")
def batch_gather_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(orders_index(spark, sf_dir), [7, 3, 7, 11, 0, 3]).select("pos", "frame_index", "n_atoms")


def _one_batch(frames: DataFrame, size: int) -> DataFrame:
    return frames.withColumn("batch_id", F.floor(F.col("frame_index") / size).cast("bigint")).withColumn("pos_in_batch", (F.col("frame_index") % size).cast("bigint"))


@query(f"""with {_CV}, k as (select fi // 8 b, bool_or(conv_id % 4 = 3) r from cv group by 1),
  t as (select conv_id, turn, length(text) len, row_number() over (partition by conv_id order by turn, role, text) - 1 as k from conversations)
  select b::bigint batch_id, (row_number() over (partition by b order by fi, k) - 1)::int atom, case when r then 'R' else 'I' end kind, len::double as "value" from t join cv using (conv_id) join k on b = fi // 8""")
def batch_int_real_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = batch.assembled(_one_batch(talks(spark, sf_dir), 8)).select("batch_id", F.explode("columns").alias("c")).where("c.name = 'len'")
    values = F.coalesce(F.col("c.r"), F.col("c.i").cast("array<double>"))
    return both.select("batch_id", F.posexplode(values).alias("atom", "value"), F.col("c.kind").alias("kind"))


@query(f"""with {_CV}, {_COLS}, {_META}, e as (select fi, 'column' as axis, name, kind, width::int w from cols union all select fi, 'metadata', key, kind, case shape when '' then 1 else shape::int end from meta),
  f as (select * from e where fi % 8 = 0), later as (select fi from cv where fi % 8 > 0),
  j as (select l.fi, f.axis, f.name, f.kind ck, f.w cw, e.kind ek, e.w ew from later l join f on f.fi = l.fi // 8 * 8 left join e on e.fi = l.fi and e.axis = f.axis and e.name = f.name)
  select (fi // 8)::bigint batch_id, (fi % 8)::bigint pos_in_batch, axis, name, case when ek is null then 'missing' else 'mismatch' end deviation, ck || ':' || cw expected, ek || ':' || ew found
  from j where ek is null or ew <> cw or (ek <> ck and not (ek in ('I', 'R') and ck in ('I', 'R')))
  union all select (e.fi // 8)::bigint, (e.fi % 8)::bigint, e.axis, e.name, 'unexpected', null, e.kind || ':' || e.w from e where e.fi % 8 > 0 and not exists (select 1 from f where f.fi = e.fi // 8 * 8 and f.axis = e.axis and f.name = e.name)""")
def batch_drift_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.drift(_one_batch(talks(spark, sf_dir), 8))


@query()
def batch_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NumPy's seeded permutation has no SQL form; a test holds it against NumPy."""
    index = talks_index(spark, sf_dir).select("frame_index", "n_atoms")
    return batch.fixed_plan(batch.shuffled(index, index.count(), 7), 8, "order")


@query(f"with {_CV} select (fi // 8)::bigint batch_id, count(*)::int n_frames, sum(n)::bigint n_atoms, min(fi)::bigint first_frame from cv group by 1")
def batch_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = batch.assembled(_one_batch(talks(spark, sf_dir), 8))
    return b.select("batch_id", F.size("frame_indices").alias("n_frames"), F.aggregate("n_atoms", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("n_atoms"), F.col("frame_indices")[0].alias("first_frame"))


# E: inference


@query(f"with {_CV}, {_COLS} select name, kind, width::int width, count(*) frames from cols group by all")
def schema_fold_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infer.column_fold(talks(spark, sf_dir)).select("name", F.explode("variants").alias("v")).select("name", "v.*")


@query(f"with {_CV}, {_META} select key, kind, shape, count(*) frames from meta group by all")
def schema_fold_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = infer.metadata_fold(talks(spark, sf_dir)).select("key", F.explode("variants").alias("v"))
    return each.select("key", "v.kind", F.array_join(F.col("v.shape").cast("array<string>"), ",").alias("shape"), "v.frames")


@query(f"""with {_CV}, {_COLS}, v as (select name, kind, width, min(fi) first from cols group by all),
  u as (select name, count(*) k, min(kind) a, max(kind) b, min(width) x, max(width) y, arg_min(kind, first) fk from v group by name)
  select name, k::int n_variants, case when k = 1 then a when k = 2 and a = 'I' and b = 'R' and x = y then 'R' end unified_kind, (case when k = 1 or (k = 2 and a = 'I' and b = 'R' and x = y) then x end)::int unified_width, fk first_kind from u""")
def schema_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = infer.unified(F.col("variants"), "width")
    return infer.column_fold(talks(spark, sf_dir)).select("name", F.size("variants").alias("n_variants"), one["kind"].alias("unified_kind"), one["width"].alias("unified_width"), F.col("variants")[0]["kind"].alias("first_kind"))


@query(f"with {_CV}, {_COLS} select name, count(*) frames_present, count(distinct kind || width) = 1 and count(*) = (select count(*) from cv) consistent from cols group by name")
def schema_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = talks(spark, sf_dir)
    return infer.column_fold(table).select("name", "frames_present", ((F.size("variants") == 1) & (F.col("frames_present") == F.lit(table.count()))).alias("consistent"))


@query(f"""with {_CV}, {_COLS}, {_META}, n as (select count(*) n, sum(n)::bigint a, min(n) lo, max(n) hi from cv),
  v as (select name, kind, width, count(*) f, min(fi) first from cols group by all),
  c as (select name, min(first) lo, string_agg(kind || ':' || width || ' (' || f || '/' || (select n from n) || ' frames)', ', ' order by first) txt, count(*) k, min(kind) a, max(kind) b, min(width) x, max(width) y from v group by name)
  select '  ' || name || ': ' || txt || case when k = 1 then '' when k = 2 and a = 'I' and b = 'R' and x = y then ' (unifies to R:' || x || ')' else ' [inconsistent]' end line from c
  union all select n || ' frames, ' || a || ' atoms (min ' || lo || ', max ' || hi || ')' from n union all select 'per-atom columns:'""")
def schema_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head and the column lines of the report; the driver only formats what the fold gave."""
    lines = infer.infer(talks(spark, sf_dir)).report().split("\n")
    kept = [lines[0], *lines[2 : lines.index("metadata:") - 1]]
    return spark.createDataFrame([(x,) for x in kept], "line string")


# F: validation

SPEC = SchemaSpec(
    (ColumnRule("role", Kind.STR), ColumnRule("len", Kind.INT), ColumnRule("extra", Kind.REAL, 3), ColumnRule("x_*", Kind.REAL, required=False)),
    (MetadataRule("turns", Kind.INT), MetadataRule("has_system", Kind.BOOL), MetadataRule("w", Kind.REAL, (2,)), MetadataRule("d*", Kind.INT, count=2)),
    FrameRule(3, 6, True),
)


def _found(spark: SparkSession, sf_dir: str, deviation: str, axis: str | None = None, level: str = "strict") -> DataFrame:
    out = match.violations(talks(spark, sf_dir), SPEC, level).where(F.col("deviation") == deviation)
    return (out if axis is None else out.where(F.col("axis") == axis)).select("frame_index", "axis", "name", "expected", "found")


@query(f"""with {_CV} select fi::bigint frame_index, 'column' as axis, 'extra' as name, 'R:3' expected, null::varchar found from cv where conv_id % 3 <> 0
  union all select fi::bigint, 'metadata', 'has_system', 'L', null from cv where not sys""")
def validate_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, "missing")


@query(f"""with {_CV} select fi::bigint frame_index, 'metadata' as axis, 'tag' as name, null::varchar expected, case when conv_id % 5 = 0 then 'I' else 'S' end found from cv
  union all select fi::bigint, 'metadata', 'Lattice', null, 'I[9]' from cv""")
def validate_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, "extra")


@query(f"""with {_CV} select fi::bigint frame_index, 'column' as axis, 'len' as name, 'I:1' expected, 'R:1' found from cv where conv_id % 4 = 3
  union all select fi::bigint, 'column', 'extra', 'R:3', 'R:2' from cv where conv_id % 6 = 0
  union all select fi::bigint, 'metadata', 'w', 'R[2]', 'R[' || (n % 3 + 1) || ']' from cv where n % 3 <> 1
  union all select fi::bigint, 'frame', 'n_atoms', '[3, 6]', n::varchar from cv where n < 3 or n > 6""")
def validate_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, "mismatch")


@query(f"with {_CV} select fi::bigint frame_index, 'metadata' as axis, 'd*' as name, '2' expected, '3' found from cv")
def validate_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, "count")


@query(f"with {_CV} select fi::bigint frame_index, 'frame' as axis, 'n_atoms' as name, '[3, 6]' expected, n::varchar found from cv where n < 3 or n > 6")
def validate_frame_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, "mismatch", "frame", "required")


@query(f"""with {_CV}, v as (select fi, 'column' as axis, 'len' as name, 'mismatch' as deviation, 'I:1' expected, 'R:1' found from cv where conv_id % 4 = 3
  union all select fi, 'column', 'extra', 'mismatch', 'R:3', 'R:2' from cv where conv_id % 6 = 0 union all select fi, 'column', 'extra', 'missing', 'R:3', null from cv where conv_id % 3 <> 0
  union all select fi, 'metadata', 'has_system', 'missing', 'L', null from cv where not sys union all select fi, 'metadata', 'w', 'mismatch', 'R[2]', 'R[' || (n % 3 + 1) || ']' from cv where n % 3 <> 1
  union all select fi, 'metadata', 'd*', 'count', '2', '3' from cv union all select fi, 'frame', 'n_atoms', 'mismatch', '[3, 6]', n::varchar from cv where n < 3 or n > 6)
  select axis, name, deviation, expected, found, count(*) frames, min(fi)::bigint first_frame, (min(fi) * 10 + 1)::bigint first_line from v group by all""")
def check_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.grouped(match.violations(talks(spark, sf_dir), SPEC, "required")).drop("first_ordinal")


# G: projection

FIXED = SchemaSpec(
    (ColumnRule("role", Kind.STR), ColumnRule("len", Kind.INT, fill=-1), ColumnRule("extra", Kind.REAL, 3, required=False)),
    (MetadataRule("turns", Kind.INT), MetadataRule("has_system", Kind.BOOL, required=False, fill=False), MetadataRule("w", Kind.REAL, (2,), fill=0.25)),
    None,
    "project",
)


@query(f"""with {_CV} select fi::bigint frame_index, case when conv_id % 4 = 3 then -n else (select sum(length(text)) from conversations c where c.conv_id = cv.conv_id) end::bigint sum_len,
  (conv_id % 3 <> 0 or conv_id % 6 = 0) filled_extra, n turns, sys has_system, case when n % 3 = 1 then 1.0 else 0.5 end::double w_sum from cv""")
def project_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = project.project(talks(spark, sf_dir), FIXED)
    total = lambda c, t: F.aggregate(c, F.lit(0).cast(t), lambda a, v: a + v)
    return p.select("frame_index", total("len", "bigint").alias("sum_len"), F.isnan(F.flatten("extra")[0]).alias("filled_extra"), "turns", "has_system", total("w", "double").alias("w_sum"))


DROPPING = SchemaSpec((ColumnRule("len", Kind.INT),), (MetadataRule("has_system", Kind.BOOL),), None, "project")


@query(f"with {_CV} select fi::bigint frame_index, conv_id % 4 = 3 or not sys dropped from cv")
def project_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.project(talks(spark, sf_dir), DROPPING).select("frame_index", "dropped")


@query(f"""with {_CV} select fi::bigint frame_index, 'column' as axis, 'len' as name, 'mismatch' as deviation, 'I:1' expected, 'R:1' found from cv where conv_id % 4 = 3
  union all select fi::bigint, 'column', 'extra', 'mismatch', 'R:3', 'R:2' from cv where conv_id % 6 = 0
  union all select fi::bigint, 'metadata', 'w', 'mismatch', 'R[2]', 'R[' || (n % 3 + 1) || ']' from cv where n % 3 <> 1""")
def project_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.project(talks(spark, sf_dir), FIXED).select("frame_index", F.explode("deviations").alias("v")).select("frame_index", "v.*")


@query(f"""with {_CV} select name, kind, width::int width, required from (
  select 'role' as name, 'S' as kind, 1 as width, true required union all select 'turns', 'I', 1, true union all select 'd' || unnest([0, 1, 2]), 'I', 1, true
  union all select 'has_system', 'L', 1, (select bool_and(sys) from cv))""")
def freeze_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = SchemaSpec((ColumnRule("ro*", Kind.STR),), (MetadataRule("turns", Kind.INT), MetadataRule("re:d[0-9]", Kind.INT), MetadataRule("has_*", Kind.BOOL, fill=False)))
    frozen = spec.freeze(infer.infer(talks(spark, sf_dir)))
    rows = [(r.name, r.kind.value, r.width, r.required) for r in frozen.columns] + [(r.key, r.kind.value, 1, r.required) for r in frozen.metadata]
    return spark.createDataFrame(rows, "name string, kind string, width int, required boolean")


@query("""with f as (select regexp_extract(name, '^(.*?)([0-9]+)$', 1) stem, name from (select distinct 'Brand_' || regexp_extract(p_brand, '([0-9]+)$', 1) as name from part union all select 'solo7' union all select 'plain'))
  select case when count(*) >= 3 then stem || '*' else min(name) end as name, (case when count(*) >= 3 then count(*) end)::int n from f group by case when stem = '' then name else stem end, stem""")
def emit_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "part").select(F.concat(F.lit("Brand_"), F.regexp_extract("p_brand", "([0-9]+)$", 1)).alias("name")).distinct()
    names = own.union(spark.createDataFrame([("solo7",), ("plain",)], "name string"))
    each = names.select(F.lit(0).cast("bigint").alias("frame_index"), F.hash("name").alias("pos"), "name", F.lit("I").alias("kind"), F.lit(1).alias("width"))
    found = infer.fold(each, "name", ["kind", "width"]).collect()
    schema = infer.Schema(1, 1, 1, 1, tuple(infer.ColumnSchema(r["name"], tuple(infer.ColumnVariant(v["kind"], v["width"], v["frames"]) for v in r["variants"]), r["frames_present"]) for r in found), ())
    return spark.createDataFrame([(r.name, r.count) for r in schema.to_spec().columns], "name string, n int")


# H: writing


def item_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with line items as writable frames: species, pos and two more columns."""
    items = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*ITEM_ORDER, "l_returnflag", "l_quantity", "l_discount", "l_tax", "l_linestatus"))).alias("a"))
    get = lambda f: F.transform("a", f)
    columns = F.array(
        tagged("open", "L", F.lit(1), b=get(lambda v: v["l_linestatus"] == "O")), tagged("pos", "R", F.lit(3), r=F.flatten(get(lambda v: F.array(v["l_quantity"], v["l_discount"], v["l_tax"])))),
        tagged("part", "I", F.lit(1), i=get(lambda v: v["l_partkey"])), tagged("species", "S", F.lit(1), s=get(lambda v: v["l_returnflag"])),
    )
    flat = F.array().cast("array<int>")
    metadata = F.array(tagged("order", "I", flat, i=F.array("l_orderkey"), column=False), tagged("pbc", "L", F.array(F.lit(3)), b=F.array(*(F.col("l_orderkey") % 2 == k for k in (0, 1, 0))), column=False))
    return items.select(F.lit("orders").alias("source"), F.col("l_orderkey").alias("frame_index"), F.size("a").cast("bigint").alias("n_atoms"), columns.alias("columns"), metadata.alias("metadata"))


@query(f"with {_ITEMS} select l_orderkey frame_index, k::int atom, l_returnflag species, l_quantity x, l_discount y, l_tax z, l_partkey part, l_linestatus = 'O' is_open from items")
def write_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = text.parsed(text.encoded(item_frames(spark, sf_dir)))
    c = lambda name, s: targets.entry("columns", name)[s]
    p = c("pos", "r")
    each = F.transform(c("species", "s"), lambda v, i: F.struct(v.alias("species"), F.get(p, i * 3).alias("x"), F.get(p, i * 3 + 1).alias("y"), F.get(p, i * 3 + 2).alias("z"), F.get(c("part", "i"), i).alias("part"), F.get(c("open", "b"), i).alias("is_open")))
    return back.select("frame_index", F.posexplode(each).alias("atom", "a")).select("frame_index", "atom", "a.*")


@query("""with n as (select l_orderkey, count(*) n from lineitem group by 1), t as (select l_orderkey k, n, case when l_orderkey % 2 = 0 then 'T' else 'F' end a, case when l_orderkey % 2 = 1 then 'T' else 'F' end b from n)
  select k frame_index, n::varchar || chr(10) || 'pbc="' || a || ' ' || b || ' ' || a || '" Properties=species:S:1:pos:R:3:open:L:1:part:I:1 order=' || k head from t""")
def write_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split("text", "\n")
    return text.encoded(item_frames(spark, sf_dir)).select("frame_index", F.concat_ws("\n", lines[0], lines[1]).alias("head"))


# I: targets


@query("""select n_nationkey, case when n_nationkey % 3 = 0 then 'fe' when n_nationkey % 3 = 1 then 'O' else 'XX' end symbol, (case when n_nationkey % 3 = 0 then 26 when n_nationkey % 3 = 1 then 8 end)::int z,
  case when n_nationkey % 3 = 0 then 55.845 when n_nationkey % 3 = 1 then 15.999 end::double mass from nation""")
def species_to_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey") % 3
    symbol = F.when(k == 0, "fe").when(k == 1, "O").otherwise("XX")
    own = read(spark, sf_dir, "nation").select("n_nationkey", symbol.alias("symbol"))
    return own.join(F.broadcast(elements.table(spark).withColumnRenamed("symbol", "known")), elements.canonical(F.col("symbol")) == F.col("known"), "left").select("n_nationkey", "symbol", "z", "mass")


@query("""with z as (select c_custkey, (c_custkey % 3)::int a, (c_custkey % 2 * 7)::int b from customer)
  select c_custkey, [1.0, 1.008, 4.002602][a + 1]::double + (case b when 0 then 1.0 else 14.007 end)::double total from z""")
def masses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    m = elements.masses_of(F.array((k % 3).cast("int"), (k % 2 * 7).cast("int")))
    return read(spark, sf_dir, "customer").select("c_custkey", (m[0] + m[1]).alias("total"))


def _cells(order: list[int]) -> str:
    m = _l("conv_id")
    return ", ".join(f"({m[k]})::double m{j}" for j, k in enumerate(order))


_PARTLY = ", ".join(f"(case when {k} < 6 or conv_id % 2 = 0 then {m} else 0 end)::double m{k}" for k, m in enumerate(_l("conv_id")))


@query(f"with {_CV} select fi::bigint frame_index, {_cells(list(range(9)))}, true as periodic from cv")
def ase_cell_pbc(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = talks(spark, sf_dir).select("frame_index", targets.cell().alias("cell"), targets.pbc().alias("pbc"))
    return a.select("frame_index", *(F.col("cell")[i // 3][i % 3].alias(f"m{i}") for i in range(9)), F.forall("pbc", lambda v: v).alias("periodic"))


@query(f"with {_CV} select fi::bigint frame_index, {_PARTLY}, conv_id % 2 = 1 differs from cv")
def metatomic_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.array(tagged("pbc", "L", F.array(F.lit(3)), b=F.array(F.lit(True), F.lit(True), F.col("conv_id") % 2 == 0), column=False)).cast(f"array<{ENTRY}>")
    s = targets.systems(talks(spark, sf_dir).withColumn("metadata", F.concat("metadata", own)))
    return s.select("frame_index", *(F.col("cell")[i // 3][i % 3].alias(f"m{i}") for i in range(9)), F.col("cell_differs").alias("differs"))


@query(f"with {_CV} select fi::bigint frame_index, {_cells([0, 3, 6, 1, 4, 7, 2, 5, 8])}, n n_atoms, true as periodic from cv")
def torchsim_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = targets.state(talks(spark, sf_dir))
    return s.select("frame_index", *(F.col("cell")[i // 3][i % 3].alias(f"m{i}") for i in range(9)), "n_atoms", F.forall("pbc", lambda v: v).alias("periodic"))


@query(f"with {_CV} select fi::bigint frame_index, n::double as \"value\" from cv")
def per_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.per_config(talks(spark, sf_dir), "turns").select("frame_index", F.col("values")[0].alias("value"))


@query(f"""with {_CV}, t as (select conv_id, length(text) len, row_number() over (partition by conv_id order by turn, role, text) - 1 as k from conversations)
  select fi::bigint frame_index, k::bigint atom_index, 0::int component, len::double as "value" from t join cv using (conv_id)""")
def per_atom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.per_atom(talks(spark, sf_dir), "len").drop("source")


# duplicates and concatenation


@query(f"with {_CV} select fi::bigint frame_index, case when conv_id % 5 = 0 then 'I' else 'S' end kind, case when conv_id % 5 = 0 then conv_id::varchar else 'c' || conv_id end as \"value\" from cv")
def dedup_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.filter(infer.last_wins(F.col("metadata"), "key"), lambda m: m["key"] == "tag")
    return talks(spark, sf_dir).select("frame_index", kept.alias("t")).select("frame_index", F.col("t")[0]["kind"].alias("kind"), F.coalesce(F.col("t")[0]["s"][0], F.col("t")[0]["i"][0].cast("string")).alias("value"))


@query(f"with {_CV}, {_EV} select fi::bigint frame_index, n n_atoms from cv union all select (fi + (select count(*) from cv))::bigint, n from ev")
def append_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = talks_index(spark, sf_dir).select("frame_index", "n_atoms")
    n = first.count()
    return first.union(users_index(spark, sf_dir).select((F.col("frame_index") + n).alias("frame_index"), "n_atoms"))


@query("select vec_id frame_index, (generate_subscripts(embedding, 1) - 1)::int component, unnest(embedding)::double as \"value\" from embeddings")
def wide_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_index"), F.col("embedding").cast("array<double>").alias("v"))
    frames = vectors.select(F.lit("e").alias("source"), "frame_index", F.lit(1).cast("bigint").alias("n_atoms"), F.array(tagged("emb", "R", F.size("v"), r=F.col("v"))).alias("columns"), F.array().cast(f"array<{ENTRY}>").alias("metadata"))
    return targets.per_atom(frames, "emb").select("frame_index", "component", "value")
