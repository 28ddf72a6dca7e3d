"""Queries: derived features, geometry, kernel names, trees, scopes."""

from pyspark.sql import functions as F

from perfspark.functions import arrays, numbers
from perfspark.operators import derive, scopes
from perfspark.plans import views
from perfspark.plans.registry import query


@query(
    "feature_slice", "samples",
    """SELECT sample_id, avg AS label, std AS std, flops, features[1] AS f0, features[4] AS f3,
       len(features) AS n FROM samples""",
)
def _(spark, d):
    rows = views.samples(spark, d).select(
        "sample_id", F.concat(F.array("avg", "std", "flops"), "features").alias("row")
    )
    f = derive.feature_slice(rows, "row", 3)
    return f.select(
        "sample_id", "label", F.col("pre_dims")[0].alias("std"), F.col("pre_dims")[1].alias("flops"),
        F.col("features")[0].alias("f0"), F.col("features")[3].alias("f3"), F.size("features").alias("n"),
    )


@query(
    "binary_descriptor", "vector_entries",
    "SELECT id, string_agg(bit, '' ORDER BY o) AS descriptor FROM b GROUP BY id",
    b="""SELECT id, pos // 8 AS o, CASE WHEN sum(v ORDER BY pos)/8 > 0 THEN '1' ELSE '0' END AS bit
         FROM vector_entries GROUP BY id, o""",
)
def _(spark, d):
    bits = derive.binary_descriptor("x", 8, 8, 0.0)
    return views.vectors(spark, d).select(
        "id", F.array_join(F.transform(bits, lambda b: b.cast("int").cast("string")), "").alias("descriptor")
    )


@query(
    "constant_feature_pruning", "coarse_samples",
    """SELECT sample_id, CASE WHEN c0 THEN '' ELSE x0 || ',' END || CASE WHEN c3 THEN '' ELSE x3 || ',' END
              || x1 || ',' || x2 AS kept
       FROM coarse_samples, (SELECT min(x0)=max(x0) AS c0, min(x3)=max(x3) AS c3 FROM coarse_samples)""",
)
def _(spark, d):
    s = views.coarse_samples(spark, d)
    order = s.select("sample_id", F.array(F.col("x")[0], F.col("x")[3], F.col("x")[1], F.col("x")[2]).alias("x"))
    kept = derive.prune_constant(order, "x")
    return kept.select("sample_id", F.array_join(F.col("x").cast("array<string>"), ",").alias("kept"))


@query(
    "constant_feature_report", "coarse_samples",
    """SELECT pos, round(avg(v), 6) AS mean, min(v) AS low, min(v)=max(v) AS is_constant,
              min(v)=max(v) AND min(v)<>0 AS is_nonzero_constant
       FROM (SELECT unnest([0,1,2,3]) AS pos, unnest([x0,x1,x2,x3]) AS v FROM coarse_samples) GROUP BY pos""",
)
def _(spark, d):
    return derive.constant_features(views.coarse_samples(spark, d), "x").withColumn("mean", F.round("mean", 6))


def leaf_rows(spark, d):
    """Samples as matrices: leaf i holds i times the feature vector."""
    leaf = lambda i: F.transform("features", lambda v: v * i)
    ast = F.transform(F.sequence(F.lit(1), F.col("leaves")), leaf)
    return views.samples(spark, d).select("sample_id", "leaves", ast.alias("ast"))


@query(
    "leaf_collapse", "samples",
    """SELECT sample_id, round(features[1]*leaves*(leaves+1)/2, 6) AS s0, round(features[4]*leaves*(leaves+1)/2, 8) AS s3,
              round(features[1]*(leaves+1)/2, 6) AS m0 FROM samples""",
)
def _(spark, d):
    rows = leaf_rows(spark, d).withColumns({
        "s": derive.leaf_collapse(F.col("ast")), "m": derive.leaf_collapse(F.col("ast"), "mean")})
    return rows.select(
        "sample_id", F.round(F.col("s")[0], 6).alias("s0"), F.round(F.col("s")[3], 8).alias("s3"), F.round(F.col("m")[0], 6).alias("m0"))


@query(
    "pad_sequence", "samples",
    """SELECT sample_id, 16 AS rows, leaves, 1.0::DOUBLE AS end_token, round(list_sum(features)*leaves*(leaves+1)/2 + 4, 8) AS total FROM samples""",
)
def _(spark, d):
    padded = leaf_rows(spark, d).withColumn("p", derive.pad_sequence(F.col("ast"), 4))
    return padded.select(
        "sample_id", F.size("p").alias("rows"), "leaves", F.element_at("p", F.col("leaves") + 1)[0].alias("end_token"),
        F.round(arrays.total(F.flatten("p")), 8).alias("total"))


@query(
    "tree_positional_encoding", "",
    """SELECT conv_id AS sample_id, turn + 1 AS node, round(sin(p), 6) AS e0,
              round(cos(p/pow(10000.0::DOUBLE, 0.5)), 6) AS e1, round(sin(p/10000.0::DOUBLE), 6) AS e2,
              round(cos(p/pow(10000.0::DOUBLE, 1.5)), 6) AS e3
       FROM (SELECT *, (2*turn + 1)::DOUBLE AS p FROM conversations)""",
)
def _(spark, d):
    t = views.trees(spark, d).withColumn("pe", derive.positional_encoding("tree", "node_ids", 4))
    rows = t.select("sample_id", F.explode(F.arrays_zip("node_ids", "pe")).alias("z"))
    return rows.select(
        "sample_id", F.col("z.node_ids").alias("node"),
        *[F.round(F.col("z.pe")[k], 6).alias(f"e{k}") for k in range(4)],
    )


@query(
    "tree_decode", "",
    """SELECT conv_id AS sample_id, (turn + 1)::INT AS node, 0 AS parent, 1 AS depth, true AS is_leaf,
              '0,' || string_agg((turn + 1) || ',-1,', '' ORDER BY turn) OVER (PARTITION BY conv_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) || '-1' AS signature
       FROM conversations
       UNION ALL SELECT conv_id, 0, NULL, 0, false,
              '0,' || string_agg((turn + 1) || ',-1,', '' ORDER BY turn) || '-1' FROM conversations GROUP BY conv_id""",
)
def _(spark, d):
    t = views.trees(spark, d).withColumn("signature", derive.tree_signature("tree"))
    return derive.tree_nodes(t, "tree", ["sample_id", "signature"])


@query(
    "device_feature_vector", "devices",
    """SELECT device_name, round(clock_MHz/2000, 6) AS f1, round(log2(memory_gb)/log2(64), 6) AS f2,
              round(log2(shm_L3_kb)/log2(256), 6) AS f3, round(log2(L2cache_mb)/log2(64), 6) AS f4,
              round(log2(L1cache_kb)/log2(256), 6) AS f5, round(log2(BW_gbps)/log2(2048), 6) AS f6,
              round(fp32_tflops/12, 6) AS f7 FROM devices""",
)
def _(spark, d):
    v = views.devices(spark, d).withColumn("v", derive.device_feature_vector())
    return v.select("device_name", *[F.round(F.col("v")[i], 6).alias(f"f{i}") for i in range(1, 8)])


_GEMM = """SELECT *,
    CASE conv_kind WHEN 'fprop' THEN bs*P*Q WHEN 'dgrad' THEN bs*H*W WHEN 'wgrad' THEN K END AS m,
    CASE conv_kind WHEN 'fprop' THEN K WHEN 'dgrad' THEN C WHEN 'wgrad' THEN R*S*C END AS n,
    CASE conv_kind WHEN 'fprop' THEN R*S*C WHEN 'dgrad' THEN R*S*K WHEN 'wgrad' THEN bs*P*Q END AS kk
    FROM {src}"""


@query("conv_gemm_size", "ops", "SELECT op_id, m, n, kk AS k FROM g WHERE op_type = 'Conv2D'",
       g=_GEMM.format(src="ops"))
def _(spark, d):
    conv = views.ops(spark, d).where("op_type = 'Conv2D'")
    return conv.select("op_id", derive.gemm_size().alias("g")).select("op_id", "g.m", "g.n", "g.k")


_FEATS = """SELECT *, CASE WHEN op_type='Conv2D' THEN m*n*kk*2 + m*n*2 ELSE bs_mult*bs*C_in*C_out END AS op_flops,
    CASE WHEN op_type='Conv2D' THEN m*n + n*kk + m*n
         ELSE bs_mult*bs*C_in + C_in*C_out + bs_mult*bs*C_out END
      * CASE dtype WHEN 'fp16' THEN 2 ELSE 4 END AS size,
    CASE WHEN op_type='Conv2D' THEN bs*Q*P*R*S*C ELSE 1 END AS transform FROM g"""


@query(
    "derive_op_features", "ops",
    """SELECT op_id, op_flops, size, transform, round(op_flops/size, 6) AS ai,
              round(op_flops/(ave*0.001::DOUBLE)/1e6, 3) AS perf_m FROM f""",
    g=_GEMM.format(src="ops"), f=_FEATS,
)
def _(spark, d):
    f = derive.op_features(views.ops(spark, d))
    return f.select(
        "op_id", "op_flops", "size", F.col("transform").cast("bigint").alias("transform"),
        F.round("ai", 6).alias("ai"), F.round(F.col("perf") / 1e6, 3).alias("perf_m"),
    )


@query(
    "shapes_to_op_params", "ops",
    """SELECT op_id, H, W, C, R, S, P, Q, K, round_even(H/P, 0)::BIGINT AS stride, C_in, C_out,
              CASE WHEN op_type='MatMul' THEN bs END AS bs_prime FROM ops""",
)
def _(spark, d):
    o = views.ops(spark, d)
    conv = F.col("op_type") == "Conv2D"
    meta = o.select(
        "op_id", F.col("op_type").alias("op"),
        F.when(conv, F.array(F.array("bs", "H", "W", "C"), F.array("R", "S", "C", "K")))
        .otherwise(F.array(F.array("bs", "C_in"), F.array("C_in", "C_out"))).alias("inputs"),
        F.when(conv, F.array(F.array("bs", "P", "Q", "K"))).otherwise(F.array(F.array("bs", "C_out"))).alias("outputs"),
    )
    return derive.shapes_to_params(meta).drop("op", "inputs", "outputs")


_KERNEL_SQL = r"""SELECT op_id, kernel,
    regexp_extract(kernel, '_(\d+)x\d+_\d+x', 1)::BIGINT AS tm,
    regexp_extract(kernel, '_\d+x(\d+)_\d+x', 1)::BIGINT AS tn,
    regexp_extract(kernel, '_\d+x\d+_(\d+)x', 1)::BIGINT AS tk FROM kernels"""


@query(
    "parse_kernel_name", "ops kernels",
    """SELECT op_id, tm::DOUBLE AS k_threadblock_m, tn*10.0::DOUBLE AS k_threadblock_n, tk::DOUBLE AS k_threadblock_k,
       2.0::DOUBLE AS k_pipeline_stage,
       CASE WHEN dtype='fp16' THEN 80.0::DOUBLE ELSE -10.0::DOUBLE END AS k_align,
       CASE WHEN dtype='fp16' THEN 1688.0::DOUBLE ELSE -1.0::DOUBLE END AS k_tensor_core_size,
       CASE WHEN dtype='fp16' THEN 0.0::DOUBLE ELSE 1000.0::DOUBLE END AS k_tensor_core_or_not,
       1000.0::DOUBLE * CASE coalesce(conv_kind,'gemm') WHEN 'gemm' THEN 0 WHEN 'fprop' THEN 2 WHEN 'dgrad' THEN 3 ELSE 4 END AS k_kernel_kind,
       CASE WHEN conv_kind IS NULL THEN -1000.0::DOUBLE ELSE 1000.0::DOUBLE END AS k_iter_algo,
       1000.0::DOUBLE AS k_dtype_accum, 0.001::DOUBLE AS k_layout
       FROM kernels""",
)
def _(spark, d):
    k = derive.kernel_parts(views.kernels(spark, d), codes=True)
    names = [
        "threadblock_m", "threadblock_n", "threadblock_k", "pipeline_stage", "align", "tensor_core_size",
        "tensor_core_or_not", "kernel_kind", "iter_algo", "dtype_accum", "layout",
    ]
    return k.select("op_id", *["k_" + n for n in names])


@query(
    "enrich_device_pair", "ops kernels devices",
    """SELECT op_id, s.SM_count AS source_sm_num, t.SM_count AS target_sm_num, s.BW_gbps AS source_bw,
       t.clock_MHz AS target_clock,
       CASE WHEN dtype='fp16' THEN t.tensor_core_au_per_sm ELSE t.fp32_au_per_sm END AS target_core_num,
       tb_num, wave_num, wave_num*ceil(gk/tk)::BIGINT AS pipeline_num,
       tm*tk + tk*tn AS tile_size_in, tm*tn AS tile_size_out, tm*tk*tn AS tile_flop
       FROM (SELECT *, ceil(tb_num/(40 + 10*tid))::BIGINT AS wave_num FROM
             (SELECT *, ceil(gm/tm)::BIGINT*ceil(gn/tn)::BIGINT AS tb_num FROM
              (SELECT *, coalesce(m, bs*bs_mult) AS gm, coalesce(n, C_out) AS gn, coalesce(kk, C_in) AS gk,
                      (right(gpu_model,1)::INT + 2) % 5 AS tid FROM g))) k
       JOIN devices s ON s.device_name = 'd' || right(gpu_model,1)
       JOIN devices t ON t.device_name = 'd' || tid""",
    g=_GEMM.format(src="kernels"),
)
def _(spark, d):
    k = derive.kernel_parts(views.kernels(spark, d))
    unit = F.substring("gpu_model", 2, 1).cast("int")
    k = k.withColumn("source", F.concat(F.lit("d"), unit.cast("string"))).withColumn(
        "target", F.concat(F.lit("d"), ((unit + 2) % 5).cast("string"))
    )
    e = derive.enrich_device_pair(k, views.devices(spark, d), "source", "target")
    return e.select(
        "op_id", "source_sm_num", "target_sm_num", "source_bw", "target_clock", "target_core_num",
        "tb_num", "wave_num", "pipeline_num", "tile_size_in", "tile_size_out", "tile_flop",
    )


@query(
    "fine_kernel_id", "ops kernels",
    """SELECT op_id, CASE WHEN op_type='Conv2D' THEN kernel || '_H=' || H || '_scale'
       || CASE WHEN ave >= 1 THEN '>=1ms' ELSE '<1ms' END || '_R=' || R ELSE kernel END AS fine_id FROM kernels""",
)
def _(spark, d):
    return views.kernels(spark, d).select("op_id", derive.fine_kernel_id().alias("fine_id"))


@query(
    "tensor_attr_features", "",
    """SELECT l_orderkey AS o, l_linenumber AS ln, l_partkey AS p, l_suppkey AS s, 164 AS n,
       l_quantity*8*3 AS c0, (-14)::DOUBLE AS zp0, l_discount AS scale0, 1.0::DOUBLE AS bytes0, l_quantity AS d0,
       l_quantity*8 AS c_out, 4.0::DOUBLE AS bytes_out, 1.0::DOUBLE AS float_out,
       round(l_quantity*8*3 - 14 + l_discount + 0 + 0 + 1 + l_quantity + 8 + 3
             + l_quantity*8 + 0 + l_tax + 1 + 1 + 4 + l_quantity + 8 + 7, 6) AS total
       FROM lineitem""",
)
def _(spark, d):
    li = views.table(spark, d, "lineitem")
    q = F.col("l_quantity").cast("int")
    text_in = F.format_string(
        "input_tensor:0  |  [%d,8,3]  |  int8  |  zp = -14, scale = %s  |  ModelParam = 0  |  ",
        q, F.col("l_discount").cast("string"))
    text_out = F.format_string(
        "out/node-1:0  |  [%d,8]  |  float32  |  zp = 0, scale = %s  |  ModelParam = 1  |  ",
        q, F.col("l_tax").cast("string"))
    v = li.select(
        F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("ln"),
        F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"),
        text_in.alias("ti"), text_out.alias("to"),
    ).withColumn("f", derive.tensor_attr_features(F.array("ti"), F.col("to"), [F.lit(7)]))
    f = F.col("f")
    return v.select(
        "o", "ln", "p", "s", F.size(f).alias("n"), f[0].alias("c0"), f[1].alias("zp0"), f[2].alias("scale0"),
        f[5].alias("bytes0"), f[6].alias("d0"), f[36].alias("c_out"), f[41].alias("bytes_out"),
        f[40].alias("float_out"), F.round(arrays.total(f), 6).alias("total"),
    )


_MARKED = "product(CASE WHEN lev % 3 = {} THEN extent ELSE 1 END) OVER (PARTITION BY program ORDER BY lev)"


@query(
    "nested_scope_features", "",
    f"""SELECT program, op, sum(steps) AS loop_steps, sum(depth)::BIGINT AS loop_cnt, count(*)::DOUBLE AS plain,
               sum(parallel) AS parallel, sum(block_x) AS block_x, sum(unrolled) AS unrolled
       FROM (SELECT program, CASE WHEN lev % 2 = 0 THEN 'add' ELSE 'multiply' END AS op, row_number() OVER (PARTITION BY program ORDER BY lev) AS depth,
             product(extent) OVER (PARTITION BY program ORDER BY lev) * CASE WHEN lev % 2 = 0 THEN 1 ELSE 4 END AS steps,
             {_MARKED.format(0)} AS parallel, {_MARKED.format(1)} AS block_x, {_MARKED.format(2)} AS unrolled
             FROM (SELECT l_orderkey // 7 AS program, l_linenumber AS lev, (min(l_suppkey) % 3 + 2)::DOUBLE AS extent
                   FROM lineitem GROUP BY 1, 2))
       GROUP BY program, op""",
)
def _(spark, d):
    levels = (
        views.table(spark, d, "lineitem")
        .groupBy(F.floor(F.col("l_orderkey") / 7).alias("program"), F.col("l_linenumber").alias("lev"))
        .agg((F.min("l_suppkey") % 3 + 1).alias("end"))
    )
    out = scopes.scope_features(program_texts(levels))
    return out.select("program", "op", "loop_steps", "loop_cnt", *[
        F.col("marks")[scopes.MARKS.index(m)].alias(n)
        for m, n in (("none", "plain"), ("parallel", "parallel"), ("blockIdx.x", "block_x"), ("unroll", "unrolled"))])


def program_texts(levels):
    """Program text per key: per level a loop and a statement inside it."""
    bound = F.format_string("(i%d, 0, %d) {\n", F.col("lev"), F.col("end"))
    kind = F.col("lev") % 3
    attribute = F.format_string("// attr [iter_var(blockIdx.x, , blockIdx.x)] thread_extent = %d\n", F.col("end") + 1)
    head = F.when(kind == 0, F.concat(F.lit("parallel "), bound)).when(
        kind == 1, F.concat(attribute, F.lit("for "), bound)).otherwise(F.concat(F.lit("unrolled "), bound))
    statement = F.when(F.col("lev") % 2 == 0, "  T_add(a, b)\n").otherwise("  a[ramp(i, 1, 4)] = (b[i] * c[i])\n")
    parts = F.sort_array(F.collect_list(F.struct("lev", F.concat(head, statement).alias("line"))))
    return levels.groupBy("program").agg(parts.alias("p")).select("program", F.concat(
        F.array_join(F.transform("p", lambda s: s["line"]), ""), F.repeat(F.lit("}\n"), F.size("p"))).alias("text"))


@query(
    "derive_conv_config", "ops",
    """SELECT op_id, st AS cfg_stride, pad, CASE WHEN pad = 0 THEN 'valid' WHEN pad = R // 2 THEN 'same' ELSE 'error' END AS padding
       FROM (SELECT *, round_even(((P-1)*st + R - H)/2, 0)::BIGINT AS pad
             FROM (SELECT *, round_even(H/P, 0)::BIGINT AS st FROM ops WHERE op_type='Conv2D'))""",
)
def _(spark, d):
    return derive.conv_config(views.ops(spark, d)).select("op_id", "cfg_stride", "pad", "padding")


@query(
    "softmax_entries", "vectors",
    """SELECT id, round(list_max(p), 9) AS top, round(list_sum(list_transform(p, lambda v: v * v)), 9) AS squares FROM
       (SELECT id, list_transform(e, lambda v: v / list_sum(e)) AS p FROM
         (SELECT id, list_transform(x, lambda v: exp(v - list_max(x))) AS e FROM vectors))""",
)
def _(spark, d):
    v = views.vectors(spark, d).select("id", arrays.softmax(F.col("x")).alias("p"))
    squares = arrays.total(F.transform("p", lambda v: v * v))
    return v.select("id", F.round(F.array_max("p"), 9).alias("top"), F.round(squares, 9).alias("squares"))


@query(
    "log_stamps", "",
    "SELECT event_id, strftime(make_timestamp(CAST(round(event_id * 97.5 * 1000) AS BIGINT) * 1000), '%Y-%m-%d %H:%M:%S') AS stamp FROM events",
)
def _(spark, d):
    return views.table(spark, d, "events").select("event_id", numbers.log_stamp(F.col("event_id") * 97.5).alias("stamp"))
