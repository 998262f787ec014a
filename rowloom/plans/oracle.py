"""The same results in plain SQL over the given tables."""

from __future__ import annotations

import hashlib

_SHARD_ROWS = "4096"
_ROWS = "select o_orderkey as row_id, o_orderpriority as cell_line, o_orderstatus as cell_states from orders"
_OBS = """select o_orderkey as row_id, o_orderpriority as cell_line, o_orderstatus as cell_states,
 c_nationkey as dataset_id from orders join customer on o_custkey = c_custkey"""
_COO = "select l_orderkey as row_id, l_partkey as var_id, sum(l_quantity) as value from lineitem group by 1, 2"
_SUMS = f"""select r.row_id, r.cell_line, r.cell_states, cast(count(c.var_id) as bigint) as nnz,
 coalesce(sum(c.value), 0.0) as total from ({_ROWS}) r left join ({_COO}) c on r.row_id = c.row_id group by 1, 2, 3"""
_ASIA = "select n_nationkey from nation join region on n_regionkey = r_regionkey where r_name = 'ASIA'"
_CELLS = f"select * from ({_OBS}) o where dataset_id in ({_ASIA})"
_GENES = """select cast(row_number() over (order by md5(cast(p_partkey as varchar)), p_partkey) - 1 as integer) as gene_ord,
 concat('g', cast(p_partkey as varchar)) as var_name, p_partkey as var_id from part where p_type in ('ECONOMY', 'SMALL')"""
_PERM = """select o_orderkey as row_id,
 row_number() over (order by md5(concat('42:', cast(o_orderkey as varchar))), o_orderkey) - 1 as ord from orders"""
_TIMED = """select event_id, event_type as tool, cast(user_id % 5 as integer) as epoch, value as seconds, ts,
 cast(length(event_type) % 3 * 512 + 1024 as integer) as n_rows from events"""
_LOG = f"""select tool, epoch, row_number() over (partition by tool, epoch order by event_id) - 1 as batch_idx, seconds,
 n_rows from ({_TIMED}) e"""
_EXACT = "cast(sum(cast(seconds as decimal(18,6))) as double)"
# Places and values of a group of dense rows, in whole millionths.
_X_SUM = """cast(sum(list_sum(list_transform(range(1, len(x) + 1),
 lambda i: cast(round(cast(x[i] as double) * 1e6) as bigint) * i)) * (row_id + 1)) as bigint) as x_sum"""
_DENSE = "select vec_id as row_id, embedding as x, label as code from embeddings"


def _chunks(size: int, per_window: int, source: str, key: str) -> str:
    """Global position of ``key`` under the chunk-window order."""
    return f"""
 c as (select row_id, {key} as k, {key} // {size} as ch from ({source}) s),
 p as (select ch, row_number() over (order by md5(concat('42c:', cast(ch as varchar))), ch) - 1 as cp
       from (select distinct ch from c) d),
 w as (select c.row_id, c.k, p.cp // {per_window} as win from c join p on c.ch = p.ch),
 o as (select row_id, row_number() over (order by win, md5(concat('42r:', cast(k as varchar))), k) - 1 as ord from w)"""


_RATES = """cast(count(*) as bigint) as n_batches, cast(sum(n_rows) as bigint) as n_rows, {s} as seconds,
 round(sum(n_rows) / {s}, 6) as samples_per_sec, round({s} * 1e6 / sum(n_rows), 6) as time_per_sample""".format(
    s=_EXACT
)


_LAYOUT_NAMES = """'h5py_sp', 'soma_sp', 'h5py_dense', 'zarr_sp', 'zarr_dense', 'zarr_dense_chunk', 'parquet', 'polars',
 'parquet_chunk', 'arrow', 'arrow_chunk', 'zarrV3tensorstore_dense_chunk', 'zarrV2tensorstore_dense_chunk'"""


def _layout_matrix(rows: str = "select * from orders", key: str = "o_orderkey") -> str:
    return f"""
with s as (select cast({key} // {_SHARD_ROWS} as integer) as shard_ord, count(*) as n_observations from ({rows}) r group by 1),
 l as (select unnest([{_LAYOUT_NAMES}]) as layout),
 m as (select unnest([false, true]) as random),
 a as (select *, split_part(layout, '_', 1) as kind, contains(layout, 'sp') as sparse from s, l, m)
select shard_ord, cast(n_observations as bigint) as n_observations,
 concat(layout, case when random then '_rand' else '' end) as name, kind, random, sparse,
 cast((n_observations + 127) // 128 as bigint) as n_batches
from a where not (random and kind in ('arrow', 'polars'))
 and not (sparse and kind in ('arrow', 'parquet', 'polars', 'zarrV3tensorstore', 'zarrV2tensorstore'))
 and not (not sparse and kind in ('soma'))"""


def _wide_columns(n: int = 64) -> str:
    return ", ".join(f"cast(x[{i + 1}] as double) as g{i}" for i in range(n))


def _loaded(order: str, size: str, rows: str = "n // size * size", epoch: str = "") -> str:
    """Summary of the batches of a loading run within ``rows``; ``order`` defines o(row_id, ord)."""
    return f"""
with {order},
 z as (select {size} as size, (select count(*) from orders) as n)
select {epoch} ord // size as batch_id, cast(count(*) as bigint) as n_rows, cast(sum(nnz) as bigint) as nnz, sum(total) as total,
 cast(sum(s.row_id * (ord % size)) as bigint) as order_sum, cast(count(distinct cell_line) as bigint) as n_labels
from o join ({_SUMS}) s on o.row_id = s.row_id, z
where ord < {rows} group by {"1, 2" if epoch else "1"}"""


def _size(rows: int) -> str:
    """Batch size of so many rows, or a tenth of a smaller collection."""
    return f"(select case when {rows * 10} > count(*) then greatest(1, count(*) // 10) else {rows} end from orders)"


_SIZE = _size(4096)
# The largest divisor of a window of 256 x 8 rows that is no larger.
_WINDOW_SIZE = f"(select max(d) from (select unnest(range(1, 2049)) as d) r where 2048 % d = 0 and d <= {_SIZE})"


ORACLE: dict[str, str] = {
    "loading_run_permutation": _loaded(f"o as ({_PERM})", _SIZE),
    "loading_run_block": _loaded(
        f"""p as (select row_id, row_number() over (order by md5(concat('42b:', cast(row_id // 4 as varchar))), row_id) - 1 as o
           from ({_ROWS}) r),
 o as (select row_id, row_number() over (order by o // (16 * {_SIZE}), md5(concat('42r:', cast(row_id as varchar))), row_id) - 1
       as ord from p)""",
        _SIZE,
    ),
    "loading_run_chunk_window": _loaded(_chunks(256, 8, _ROWS, "row_id"), _WINDOW_SIZE),
    "loading_run_budget": _loaded(f"o as ({_PERM})", _size(96), "least(n, 1000) // size * size"),
    "loading_run_epochs": _loaded(
        f"""e as (select row_id, cast(unnest(range(3)) as integer) as epoch from ({_ROWS}) r),
 p as (select row_id, epoch, row_number() over (partition by epoch
         order by md5(concat('42:', epoch, 'b:', row_id // 4)), row_id) - 1 as o from e),
 o as (select row_id, epoch, row_number() over (partition by epoch
         order by o // (16 * {_size(96)}), md5(concat('42:', epoch, 'r:', row_id)), row_id) - 1 as ord from p)""",
        _size(96),
        "n",
        "epoch,",
    ),
    "prepare_collections": f"""
with src as (select row_id, {_SHARD_ROWS} as size, (select max(o_orderkey) from orders) as top from ({_ROWS}) r),
 pos as (select row_id, size, row_number() over (order by -(row_id // size), row_id) - 1 as place from src),
 pm as (select row_id, size, row_number() over (order by md5(concat('42:', cast(place as varchar))), place) - 1 as ord from pos),
 sub as (select c.row_id, count(*) as nnz, sum(c.value) as total
         from ({_COO}) c join ({_GENES}) g on c.var_id = g.var_id group by 1),
 whole as (select ord // size as shard, ord as row_id, s.nnz, s.total, coalesce(sub.nnz, 0) as sub_nnz,
            coalesce(sub.total, 0.0) as sub_total
           from pm join ({_SUMS}) s on pm.row_id = s.row_id left join sub on pm.row_id = sub.row_id),
 u as (select 'orders_sharded' as collection_key, shard, row_id, nnz, total from whole
       union all select 'orders_sharded_subset', shard, row_id, sub_nnz, sub_total from whole
       union all select 'orders_chunked', shard, row_id, nnz, total from whole
       union all select 'orders_chunked_mini', shard, row_id, nnz, total from whole where shard = 0)
select collection_key, cast(shard as integer) as shard, row_id, cast(nnz as bigint) as nnz, total,
 cast(count(*) over (partition by collection_key, shard) as bigint) as n_observations from u""",
    "subset_batches": f"""
with p as (select row_id, cell_line,
  (row_number() over (order by md5(concat('42:', cast(row_id as varchar))), row_id) - 1) // 128 as b from ({_CELLS}) o),
 x as (select * from ({_COO}) c where var_id <= 999)
select cast(b as bigint) as batch_id, cast(count(distinct p.row_id) as bigint) as n_rows,
 cast(count(x.var_id) as bigint) as nnz, coalesce(sum(x.value), 0.0) as total_count,
 cast(count(distinct cell_line) as bigint) as n_labels
from p left join x on p.row_id = x.row_id group by 1""",
    "collection_scan": f"select row_id, cast(row_id // {_SHARD_ROWS} as integer) as shard, cell_line, nnz, total from ({_SUMS}) s",
    "collection_scan_first_shards": f"""select row_id, cast(row_id // {_SHARD_ROWS} as integer) as shard, cell_line, nnz, total
 from ({_SUMS}) s where row_id // {_SHARD_ROWS} < 2""",
    "unique_lookup": "select c_custkey, c_name, c_nationkey from customer where c_name = 'Customer#000000042'",
    "uid_list_scan": f"""
with k as (select row_id, concat('orders/shard_', cast(row_id // {_SHARD_ROWS} as varchar)) as shard_key from ({_ROWS}) r),
 l as (select shard_key, cast(row_number() over (order by md5(shard_key)) - 1 as integer) as list_ord
       from (select distinct shard_key from k) d)
select list_ord, k.shard_key, row_id from k join l on k.shard_key = l.shard_key""",
    "dir_suffix_scan": f"select row_id, cast(len(x) as bigint) as n_values, cast(list_max(x) as double) as largest from ({_DENSE}) d",
    "numbered_shard_scan": f"select row_id, cast(row_id // {_SHARD_ROWS} as integer) as shard, cell_states from ({_ROWS}) r",
    "concat_scan": f"select row_id, cast(row_id // {_SHARD_ROWS} as integer) as shard, cell_line, nnz, total from ({_SUMS}) s",
    "checked_concat": f"select row_id, cast(row_id // {_SHARD_ROWS} as integer) as shard, nnz, total from ({_SUMS}) s",
    "obs_columns": f"select row_id, cell_line from ({_ROWS}) r",
    "layer_select": _COO,
    "wide_scan_split": f"""select cast(v as integer) as var_id, cast(x[v + 1] as double) as value, code as label
 from (select x, code, unnest(range(len(x))) as v from ({_DENSE}) d) e""",
    "list_column_scan": f"""select row_id, cast(v as integer) as var_id, cast(x[v + 1] as double) as value
 from (select row_id, x, unnest(range(len(x))) as v from ({_DENSE}) d) e""",
    "gene_list_scan": f"select gene_ord, var_name from ({_GENES}) g",
    "write_sparse": f"select row_id, nnz, total, nnz as coo_nnz, total as coo_total from ({_SUMS}) s",
    "write_dense_chunked": f"""select row_id // 128 * 128 as first_row, cast(count(*) as bigint) as n_rows,
 cast(sum(code) as bigint) as code_sum, {_X_SUM} from ({_DENSE}) d group by 1""",
    "write_two_level_chunks": f"""
with f as (select row_id // 256 as file, count(*) as file_rows from ({_DENSE}) d group by 1)
select row_id // 32 * 32 as first_row, cast(count(*) as bigint) as n_rows, cast(max(file_rows) as bigint) as file_rows,
 cast(sum(code) as bigint) as code_sum, {_X_SUM}
from ({_DENSE}) d join f on row_id // 256 = file group by 1""",
    "write_wide_row_groups": f"""select row_id, row_id // 128 as group_id, row_id % 128 as pos,
 round(cast(x[1] as double), 6) as g0, round(cast(x[len(x)] as double), 6) as g63, cast(code as integer) as code
from ({_DENSE}) d""",
    "reshard_shuffled": f"""select cast(ord // {_SHARD_ROWS} as integer) as shard, ord as row_id, s.row_id as source_row_id,
 cell_line, nnz, total from ({_SUMS}) s join ({_PERM}) p on s.row_id = p.row_id""",
    "reshard_ordered": f"""select cast(row_id // ({_SHARD_ROWS} // 2) as integer) as shard, row_id, cell_line, nnz, total
 from ({_SUMS}) s""",
    "subset_rewrite": f"""
with e as (select c.row_id, g.gene_ord, c.value from ({_COO}) c join ({_GENES}) g on c.var_id = g.var_id)
select cast(r.row_id // {_SHARD_ROWS} as integer) as shard, r.row_id,
 coalesce(sum(e.value * (e.gene_ord + 1)), 0.0) as weighted, cast(count(e.gene_ord) as bigint) as nnz,
 coalesce(sum(e.value), 0.0) as total
from ({_ROWS}) r left join e on r.row_id = e.row_id group by 1, 2""",
    "append_loop_log": f"""select tool as name, epoch, cast(sum(cast(seconds as decimal(18,2))) as double) as seconds
 from ({_TIMED}) e group by 1, 2""",
    "nested_results_json": f"""
with l as (select * from ({_LOG}) l where batch_idx > 0),
 r as (select tool, epoch, {_RATES} from l group by 1, 2)
select l.tool, concat('epoch_', cast(l.epoch as varchar)) as epoch_key, batch_idx // 100 as segment,
 cast(row_number() over (partition by l.tool, l.epoch, batch_idx // 100 order by batch_idx) - 1 as integer) as batch_ord,
 l.seconds, r.samples_per_sec, r.time_per_sample
from l join r on l.tool = r.tool and l.epoch = r.epoch""",
    "register_collection": f"""
with s as (select cast(o_orderkey // {_SHARD_ROWS} as integer) as shard_ord, cast(count(*) as bigint) as n_observations
           from orders group by 1),
 k as (select shard_ord, concat('orders/shard_', cast(shard_ord as varchar)) as shard_key, n_observations from s)
select 'orders_parquet' as collection_key, 'orders by part' as description, shard_ord, shard_key, n_observations from k
union all
select 'orders_parquet_mini', 'first shard', shard_ord, shard_key, n_observations from k where shard_ord = 0""",
    "append_result_row": f"""
select tool, 'orders_parquet' as collection,
 (select cast(count(distinct o_orderkey // {_SHARD_ROWS}) as integer) from orders) as n_datasets,
 round(sum(n_rows) / {_EXACT}, 6) as n_samples_per_sec, 2000000 as n_samples_requested, cast(sum(n_rows) as bigint) as n_samples_loaded,
 (select cast(count(*) as bigint) from orders) as n_samples_collection,
 4 as num_workers, cast(length(tool) % 3 * 512 + 1024 as integer) as batch_size, 256 as chunk_size, 'unknown' as compute_spec, concat('run-', tool) as run,
 max(ts) as "timestamp", 'tester' as "user"
from ({_TIMED}) e group by tool""",
    "head_slice": f"select * from ({_COO}) c where row_id < 256 and var_id < 500",
    "coord_range": f"select * from ({_COO}) c where var_id <= 999",
    "value_filter_eq": f"select row_id, cell_states from ({_ROWS}) r where cell_line = '1-URGENT'",
    "axis_query": f"""select o.row_id, cell_line, var_id, value from ({_CELLS}) o
 left join (select * from ({_COO}) c where var_id <= 999) x on o.row_id = x.row_id""",
    "x_label_join": f"""
with k as (select cell_line, cast(row_number() over (order by cell_line) - 1 as integer) as label_code
           from (select distinct cell_line from ({_ROWS}) r) d)
select row_id, s.cell_line, label_code, nnz, total from ({_SUMS}) s join k on s.cell_line = k.cell_line""",
    "row_gather": f"select ord as pos, s.row_id, nnz, total from ({_SUMS}) s join ({_PERM}) p on s.row_id = p.row_id",
    "gene_subset": f"""select c.row_id, cast(g.gene_ord as bigint) as var_id, c.value
 from ({_COO}) c join ({_GENES}) g on c.var_id = g.var_id""",
    "obs_semi_join": f"select row_id, cell_line, cell_states, dataset_id from ({_CELLS}) o",
    "layout_mode_matrix": _layout_matrix(),
    "collection_total": f"""select cast(count(*) as bigint) as n_samples,
 cast(count(distinct o_orderkey // {_SHARD_ROWS}) as bigint) as n_shards from orders""",
    "throughput": f"select tool, {_RATES} from ({_TIMED}) e group by tool",
    "throughput_epochs": f"select tool, epoch, {_RATES} from ({_LOG}) l where batch_idx > 0 group by 1, 2",
    "assemble_rows": f"""
select r.row_id, min(var_id) as first_var, max(var_id) as last_var,
 coalesce(sum(value * (var_id + 1)), 0.0) as weighted, cast(count(var_id) as bigint) as nnz,
 coalesce(sum(value), 0.0) as total
from ({_ROWS}) r left join ({_COO}) c on r.row_id = c.row_id group by 1""",
    "batch_sequential": f"select row_id, cell_line, row_id // 128 as batch_id, row_id % 128 as pos from ({_ROWS}) r",
    "global_permutation": f"""select r.row_id, cell_line, ord // 128 as batch_id, ord % 128 as pos
 from ({_ROWS}) r join ({_PERM}) p on r.row_id = p.row_id""",
    "sorted_within_batch": f"""select row_id, ord // 128 as batch_id,
 row_number() over (partition by ord // 128 order by row_id) - 1 as pos from ({_PERM}) p""",
    "block_shuffle": f"""
with p as (select row_id, row_number() over (order by md5(concat('42b:', cast(row_id // 4 as varchar))), row_id) - 1 as o
           from ({_ROWS}) r),
 q as (select row_id, row_number() over (order by o // (128 * 16), md5(concat('42r:', cast(row_id as varchar))), row_id) - 1
       as ord from p)
select row_id, ord // 128 as batch_id, ord % 128 as pos from q""",
    "chunk_window_shuffle": f"""with {_chunks(256, 8, _ROWS, "row_id")}
select row_id, ord // 128 as batch_id, ord % 128 as pos from o""",
    "row_group_shuffle": f"""
with g as (select k, row_number() over (order by md5(concat('42g:', cast(k as varchar))), k) - 1 as batch_id
           from (select distinct row_id // 128 as k from ({_ROWS}) r) d)
select row_id, batch_id, row_id % 128 as pos from ({_ROWS}) r join g on row_id // 128 = k""",
    "row_group_scan": f"""select row_id, row_id // 128 as group_id, row_id % 128 as pos,
 round(cast(x[1] as double), 6) as g0, cast(code as integer) as code from ({_DENSE}) d""",
    "layout_passes": f"""
with e as (select row_id, code, cast(unnest(range(4)) as integer) as epoch,
            list_sum(list_transform(x, lambda v: cast(round(cast(v as double) * 1e6) as bigint))) as xs from ({_DENSE}) d),
 s as (select unnest([128, 65536]) as size),
 p as (select *, row_number() over (partition by epoch order by md5(concat('42:', epoch, ':', row_id)), row_id) - 1 as ord
       from e),
 g as (select epoch, size, k, row_number() over (partition by epoch, size order by md5(concat('42:', epoch, 'g:', k)), k) - 1
       as place from (select distinct epoch, size, row_id // size as k from e, s) d),
 n as (select unnest(['h5py_sp', 'soma_sp', 'h5py_dense', 'zarr_sp', 'zarr_dense', 'zarr_dense_chunk', 'polars', 'arrow',
       'arrow_chunk', 'zarrV3tensorstore_dense_chunk', 'zarrV2tensorstore_dense_chunk']) as name),
 w as (select 'parquet' as name, 65536 as size union all select 'parquet_chunk', 128),
 b as (
  select name, epoch, row_id // 128 as batch_id, code, xs from e, n
  union all select concat(name, '_rand'), epoch, ord // 128, code, xs from p, n
   where name not in ('polars', 'arrow', 'arrow_chunk')
  union all select name, epoch, row_id // size, code, xs from e, w
  union all select concat(name, '_rand'), e.epoch, place, code, xs
   from e, w join g on g.size = w.size where g.epoch = e.epoch and g.k = e.row_id // w.size)
select name, epoch, cast(batch_id as bigint) as batch_id, cast(count(*) as bigint) as n_rows,
 cast(sum(code) as bigint) as label_sum, cast(sum(xs) as bigint) as value_sum from b group by 1, 2, 3""",
    "storage_report": f"""
with n as (select count(*) as n from ({_DENSE}) d),
 r as (select unnest([{_LAYOUT_NAMES}]) as storage)
select storage, true as sized, cast(case
 when storage in ('parquet', 'polars', 'arrow') then (n + 65536 * 64 - 1) // (65536 * 64)
 when storage = 'zarrV3tensorstore_dense_chunk' then (n + 128 * 512 - 1) // (128 * 512)
 when contains(storage, 'chunk') then (n + 128 * 64 - 1) // (128 * 64) end as bigint) as n_objects from r, n""",
    "part_shuffle": f"""with {_chunks(1250, 1, _ROWS, "row_id")}
select row_id, ord // 1024 as batch_id, ord % 1024 as pos from o
where ord // 1024 < (select count(*) // 1024 from orders)""",
    "stream_chunk_shuffle": f"""
with n as (select row_id, row_number() over (order by row_id) - 1 as place from ({_CELLS}) r),
{_chunks(10000, 1, "select * from n", "place")}
select row_id, ord // 1024 as batch_id, ord % 1024 as pos from o""",
    "batch_intervals": f"""select tool, event_id, cast(epoch_us(ts) - epoch_us(coalesce(
 lag(ts) over (partition by tool order by event_id), (select min(ts) from events))) as bigint) as interval_us
 from ({_TIMED}) e""",
    "label_codes": f"""
with r as (select row_id, nullif(cell_states, 'P') as cell_states from ({_ROWS}) r),
 k as (select cell_states as v, row_number() over (order by cell_states) - 1 as code
       from (select distinct cell_states from r where cell_states is not null) d)
select row_id, cell_states, cast(coalesce(code, -1) as integer) as label_code from r left join k on cell_states = v""",
    "shard_offsets": f"""
with s as (select cast(o_orderkey // {_SHARD_ROWS} as integer) as shard_ord, cast(count(*) as bigint) as n_observations
           from orders group by 1)
select shard_ord, n_observations, cast(sum(n_observations) over (order by shard_ord) - n_observations as bigint) as first_row
from s""",
    "row_budget": f"""select row_id, ord // 128 as batch_id, ord % 128 as pos from ({_PERM}) p
 where ord < (select least(10000, count(*)) from orders)""",
    "batch_budget": f"select row_id, ord // 128 as batch_id, ord % 128 as pos from ({_PERM}) p where ord // 128 < 10000 // 128",
    "drop_last": f"""select row_id, row_id // 128 as batch_id, row_id % 128 as pos from ({_ROWS}) r
 where row_id // 128 < (select count(*) // 128 from orders)""",
    "epochs": f"""
with e as (select row_id, cast(unnest(range(5)) as integer) as epoch from ({_ROWS}) r),
 p as (select row_id, epoch, row_number() over (partition by epoch
   order by md5(concat('42:', cast(epoch as varchar), ':', cast(row_id as varchar))), row_id) - 1 as ord from e)
select row_id, epoch, ord // 1024 as batch_id, ord % 1024 as pos from p
where ord // 1024 < (select count(*) // 1024 from orders)""",
    "largest_divisor": """select p_partkey, cast(coalesce(list_max(list_filter(
 range(1, least(p_partkey, p_size) + 1), lambda d: p_partkey % d = 0)), 1) as bigint) as divisor from part""",
    "effective_batch": """
with c as (select p_partkey, p_size * 10 as win, cast(sum(cast(l_quantity as bigint)) as bigint) as n
           from lineitem join part on l_partkey = p_partkey group by 1, 2),
 b as (select *, case when 480 > n then greatest(1, n // 10) else 48 end as size from c)
select p_partkey, n as n_collection, cast(case when win % size = 0 then size else
 list_max(list_filter(range(1, least(win, size) + 1), lambda d: win % d = 0)) end as bigint) as batch_size from b""",
    "densify": f"""
with e as (select l_orderkey as row_id, s_nationkey as v, sum(l_quantity) as q
           from lineitem join supplier on l_suppkey = s_suppkey group by 1, 2)
select r.row_id, (select cast(count(*) as bigint) from nation) as n_values, cast(count(v) as bigint) as nnz,
 coalesce(sum(q), 0.0) as total, coalesce(sum(q * (v + 1)), 0.0) as weighted
from ({_ROWS}) r left join e on r.row_id = e.row_id group by 1""",
    "wide_project": f"select row_id, {_wide_columns()}, code from ({_DENSE}) d",
    "batch_callback": f"""select ord // 128 as batch_id, cast(count(*) as bigint) as n_rows, cast(sum(nnz) as bigint) as nnz,
 sum(total) as total, max(case when ord % 128 = 0 then s.row_id end) as first_row
 from ({_SUMS}) s join ({_PERM}) p on s.row_id = p.row_id group by 1""",
    "chunk_callback": f"""select row_id, cast(len(list_filter(x, lambda v: v > 0)) as bigint) as n_positive,
 cast(list_max(x) as double) as largest from ({_DENSE}) d""",
}


# --- row sets, indexed reads and keyed orders ------------------------------------


def _round_numbers(seed: str, round_: int) -> list[int]:
    return [int(hashlib.md5(f"{seed}:{round_}:{name}".encode()).hexdigest()[:7], 16) for name in "abc"]


def _rounds(source: str, seed: str) -> str:
    """``x`` of ``source`` after eight rounds on its quotient and remainder by b; sizes a and b are in ``z``."""
    sql = f"select row_id, x // b as l, x % b as r, a, b, n from ({source}) s, z"
    for i in range(8):
        mul, add, more = _round_numbers(seed, i)
        given, size = ("r", "a") if i % 2 == 0 else ("l", "b")
        mixed = f"(({given}::bigint * {mul} + {add}) % 2147483647)"
        mixed = f"(({mixed} * {mixed} + {more}) % 2147483647)"
        l, r = (f"(l + {mixed}) % {size}", "r") if i % 2 == 0 else ("l", f"(r + {mixed}) % {size}")
        sql = f"select row_id, {l} as l, {r} as r, a, b, n from ({sql}) s"
    return f"select row_id, l * b + r as x from ({sql}) s"


_Z = """z as (select n, a, (n + a - 1) // a as b from (
   select count(*) as n, ceil(sqrt(count(*)))::bigint as a from orders) c)"""


def _keyed(seed: str, name: str = "o") -> str:
    """``name(row_id, ord)``: rounds are repeated until the result is the number of a row."""
    again = f"select row_id, x from {name}_w where x >= (select n from z)"
    return f"""{name}_w as ({_rounds(f"select row_id, row_id as x from ({_ROWS}) r", seed)} union all {_rounds(again, seed)}),
 {name} as (select row_id, x as ord from {name}_w where x < (select n from z))"""


def _box(rows: str, variables: str) -> str:
    return f"select * from ({_COO}) c where row_id between {rows} and var_id between {variables}"


ORACLE |= {
    "axis_query_row_set": ORACLE["axis_query"],
    "obs_semi_join_row_set": f"""select s.row_id, cast(s.row_id // {_SHARD_ROWS} as integer) as shard, cell_line, nnz, total
 from ({_SUMS}) s where row_id in (select row_id from ({_CELLS}) c)""",
    "row_set_sizes": f"""
with r as (select cell_states as s from ({_ROWS}) r)
select s as name, count(*) as n_rows from r group by 1
union all select 'F or O', count(*) from r where s in ('F', 'O')
union all select 'all', count(*) from r""",
    "row_gather_index": f"""
with p as (select row_id, row_number() over (order by md5(concat('42:', cast(row_id as varchar))), row_id) - 1 as pos
           from ({_CELLS}) c where cell_line = '1-URGENT')
select pos, s.row_id, nnz, total from ({_SUMS}) s join p on s.row_id = p.row_id""",
    "head_slice_tiles": _box("0 and 255", "0 and 499"),
    "coord_range_tiles": _box("2000 and 5999", "100 and 999"),
    "gene_subset_columns": ORACLE["gene_subset"],
    "variable_counts": f"""select var_id, count(*) as n_entries, cast((count(*) + 4095) // 4096 as bigint) as n_segments
 from ({_COO}) c group by 1""",
    "keyed_permutation": f"""with recursive {_Z}, {_keyed("42")}
select r.row_id, cell_line, ord // 128 as batch_id, ord % 128 as pos from ({_ROWS}) r join o on r.row_id = o.row_id""",
    "keyed_epochs": f"""with recursive {_Z}, {_keyed("42:0", "o0")}, {_keyed("42:1", "o1")}, {_keyed("42:2", "o2")},
 e as (select 0 as epoch, * from o0 union all select 1, * from o1 union all select 2, * from o2)
select row_id, epoch, ord // 1024 as batch_id, ord % 1024 as pos from e
where ord // 1024 < (select count(*) // 1024 from orders)""",
    "loading_run_resumed": f"""with recursive {_Z}, {_keyed("42")}
select ord // 128 as batch_id, cast(count(*) as bigint) as n_rows, cast(sum(nnz) as bigint) as nnz, sum(total) as total,
 cast(sum(s.row_id * (ord % 128)) as bigint) as order_sum
from o join ({_SUMS}) s on o.row_id = s.row_id, (select n // 128 as last from z) l
where ord // 128 >= last // 2 and ord // 128 < last group by 1""",
    "concat_two_stores": f"""
with n as (select count(*) as n, max(o_orderkey) // {_SHARD_ROWS} + 1 as shards from orders)
select row_id, cast(row_id // {_SHARD_ROWS} as integer) as shard, cell_line, nnz, total from ({_SUMS}) s
union all
select n + ord, cast(shards + ord // {_SHARD_ROWS} as integer), cell_line, nnz, total
from ({_SUMS}) s join ({_PERM}) p on s.row_id = p.row_id, n""",
    "growing_store": f"select ord, s.row_id, cell_line, nnz, total from ({_SUMS}) s join ({_PERM}) p on s.row_id = p.row_id",
    "sized_part_shuffle": f"""
with b as (select row_id, nnz * 8 + 8 as bytes from ({_SUMS}) s),
 r as (select *, sum(case when bytes < 65536 then bytes else 0 end) over (order by row_id
          rows between unbounded preceding and 1 preceding) as before from b),
 c as (select row_id, case when bytes >= 65536 then -row_id - 1 else (coalesce(before, 0) // 65536)::bigint end as part from r),
 p as (select part, row_number() over (order by md5(concat('42c:', cast(part as varchar))), part) - 1 as place
       from (select distinct part from c) d),
 o as (select row_id, row_number() over (order by place, md5(concat('42r:', cast(row_id as varchar))), row_id) - 1 as ord
       from c join p on c.part = p.part)
select row_id, ord // 1024 as batch_id, ord % 1024 as pos from o where ord // 1024 < (select count(*) // 1024 from orders)""",
    "shard_digests": f"""
with v as (select distinct row_id // {_SHARD_ROWS} as shard, var_id from ({_COO}) c),
 n as (select shard, row_number() over (partition by shard order by var_id) - 1 as place, var_id from v)
select cast(shard as integer) as shard, count(*) as n_var,
 cast(sum(cast(concat('0x', substr(md5(concat(place, ':g', var_id)), 1, 15)) as hugeint)) as varchar) as digest
from n group by 1""",
}
