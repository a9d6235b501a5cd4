"""Queries of the alphabet engine on the given tables, with their SQL."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions import text as txt
from tessera.functions import vectors as vec
from tessera.operators import aliases as al
from tessera.operators import certify as cert
from tessera.operators import clustering, dynamics, evolution, gloss
from tessera.operators.translate import first_by, live_symbols, symbols_by_code, translate
from tessera.pack import SymbolPack, load_pack, save_pack
from tessera.plans import learn
from tessera.session import scratch_path, ship, table, written
from tessera.sources.jsonl import load_observations_jsonl, load_stream
from tessera.streaming import translate as streaming

# ---- tables


def last_packs(spark, sf_dir):
    """One row for each pack_id as spelled: the last load counts."""
    rows = table(spark, sf_dir, "symbol_packs").where("pack_id is not null")
    fields = F.struct("loaded_at", "checksum", "parent_pack_id", "reconstruction_error", "mdl_bits")
    return rows.groupBy("pack_id").agg(F.max(fields).alias("r")).select("pack_id", "r.*").drop("loaded_at")


def unique_symbols(spark, sf_dir):
    """Symbols without repeated rows."""
    return table(spark, sf_dir, "symbols").dropDuplicates(["symbol_id"])


def pack_tables(spark, sf_dir):
    return last_packs(spark, sf_dir), unique_symbols(spark, sf_dir), table(spark, sf_dir, "codebook"), table(spark, sf_dir, "pack_aliases")


def _unit_table(spark, sf_dir):
    """The embeddings as observations."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ord"), F.col("vec_id").cast("string").alias("observation_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").alias("class_id"))


def _r(column, digits=6):
    return F.round(column, digits)


# ---- translation and aliases


def translate_packs(spark, sf_dir):
    """Every code any table of a pack mentions, and one that none does, glossed by its pack."""
    ship(spark)
    packs, symbols, codebook, aliases = pack_tables(spark, sf_dir)
    told = codebook.select("pack_id", "code").union(aliases.select("pack_id", F.col("old_code").alias("code"))).union(symbols.select("pack_id", "code"))
    codes = told.union(packs.select("pack_id", F.lit(999_999).alias("code"))).distinct()
    out = translate(codes, packs, symbols, codebook, aliases)
    return out.select("pack_id", "code", "english", _r("confidence").alias("confidence"), "state", "pack_checksum", "class_id", "resolved_code", F.size("observation_ids").cast("bigint").alias("n_ids"))


def _stream_with_packs(spark, sf_dir, codes):
    """The code streams, each read by the first pack whose hash begins like the stream's (the first of all where there is none), the stream's alias map in place of the pack's."""
    packs, symbols, codebook, _ = pack_tables(spark, sf_dir)
    bucket = lambda c: F.substring(F.md5(c), 1, 2)
    named = symbols.where("pack_id is not null")
    first = named.agg(F.min("pack_id").alias("first"))
    picked = written(named.groupBy(bucket("pack_id").alias("bucket")).agg(F.min("pack_id").alias("picked")).crossJoin(F.broadcast(first)), "picked")  # 256 rows, one row
    readers = picked.select(F.explode(F.array("picked", "first")).alias("pack_id")).distinct()
    of_readers = lambda df: df.join(readers, "pack_id", "left_semi")
    aliases = table(spark, sf_dir, "stream_aliases").crossJoin(F.broadcast(readers))  # at most 257 rows
    rows = codes.withColumn("bucket", bucket("stream_id")).join(picked.select("bucket", "picked"), "bucket", "left").crossJoin(F.broadcast(first))
    rows = rows.select(F.coalesce("picked", "first").alias("pack_id"), "stream_id", "pos", "code")
    return translate(rows, of_readers(packs), written(of_readers(symbols), "symbols"), of_readers(codebook), aliases)


def translate_codes(spark, sf_dir):
    ship(spark)
    out = _stream_with_packs(spark, sf_dir, table(spark, sf_dir, "stream_codes"))
    return out.select("stream_id", "pos", "code", "state", "class_id", "resolved_code", _r("confidence").alias("confidence"))


def translate_streaming(spark, sf_dir):
    """The same by Structured Streaming: all that is available now, through the stream-static plan."""
    ship(spark)
    schema = table(spark, sf_dir, "stream_codes").schema
    codes = spark.readStream.schema(schema).parquet(f"{sf_dir}/stream_codes.parquet*")
    out = _stream_with_packs(spark, sf_dir, codes)
    return streaming.run_available(out.select("stream_id", "pos", "code", "state", "class_id", "resolved_code", _r("confidence").alias("confidence")), "glosses")


def _arriving(spark, sf_dir):
    schema = table(spark, sf_dir, "stream_codes").schema
    codes = spark.readStream.schema(schema).parquet(f"{sf_dir}/stream_codes.parquet*")
    return codes.withColumn("arrived_at", F.col("arrived_at").cast("timestamp"))


def stream_deduplicated(spark, sf_dir):
    """The events of the stream without redeliveries, by stream and position."""
    return streaming.run_available(streaming.deduplicated(_arriving(spark, sf_dir), late="3650 days").select("stream_id", "pos"), "once")


def stream_windows(spark, sf_dir):
    """Codes by hour of arrival, of the hours that are closed by the watermark."""
    return streaming.run_available(streaming.counts_by_window(_arriving(spark, sf_dir)).select(F.col("begin").cast("timestamp_ntz").alias("begin"), "code", "n"), "windows")


def rewrite_codes(spark, sf_dir):
    aliases = al.last_statements(table(spark, sf_dir, "stream_aliases").withColumn("pack_id", F.lit("stream")))
    return al.rewrite_stream(table(spark, sf_dir, "stream_codes").select("stream_id", "pos", "code", "arrived_at"), aliases).select("stream_id", "pos", "code", "arrived_at")


def alias_closure(spark, sf_dir):
    ship(spark)
    return al.alias_closure(table(spark, sf_dir, "pack_aliases"))


def alias_follow(spark, sf_dir):
    """At most 3 hops, to show the bound."""
    ship(spark)
    return al.follow_aliases(table(spark, sf_dir, "pack_aliases"), 3)


def alias_follow_default(spark, sf_dir):
    """At most as many hops as the operator's default, 64."""
    ship(spark)
    return al.follow_aliases(table(spark, sf_dir, "pack_aliases"))


def alias_cycles(spark, sf_dir):
    ship(spark)
    return al.alias_cycles(table(spark, sf_dir, "pack_aliases"))


def dangling_aliases(spark, sf_dir):
    return al.dangling_targets(al.last_statements(table(spark, sf_dir, "pack_aliases")), table(spark, sf_dir, "codebook")).select("pack_id", "old_code", "new_code")


def code_lookup(spark, sf_dir):
    found = symbols_by_code(unique_symbols(spark, sf_dir), table(spark, sf_dir, "codebook"))
    return found.select("pack_id", "code", F.col("symbol.class_id").alias("class_id"), F.col("symbol.code").alias("own_code"))


def class_lookup(spark, sf_dir):
    return first_by(unique_symbols(spark, sf_dir), "class_id").select("pack_id", "class_id", "symbol_id")


def live(spark, sf_dir):
    return live_symbols(unique_symbols(spark, sf_dir)).select("symbol_id", "pack_id", "class_id")


# ---- certification


def pack_checksums(spark, sf_dir):
    ship(spark)
    return cert.checksums(*pack_tables(spark, sf_dir))


def certify_packs(spark, sf_dir):
    ship(spark)
    out = cert.certify(*pack_tables(spark, sf_dir))
    return out.select("pack_id", "passed", "addressable", "unfoldable", "gloss_bound", "residual_ok", F.array_join("failures", "; ").alias("failures"), F.col("details.n_symbols").alias("n_symbols"), F.col("details.n_live").alias("n_live"), F.col("details.n_aliases").alias("n_aliases"))


# ---- text


def token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", txt.tokens(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.size(F.filter("t", lambda x: ~txt.is_stop_word(x))).cast("bigint").alias("n_words"))


def _by_lang(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("lang is not null").select("lang", F.col("doc_id").alias("ord"), "text")


def keywords_by_language(spark, sf_dir):
    return gloss.keywords(gloss.texts_of(_by_lang(spark, sf_dir), "lang"), "lang")


def examples_by_language(spark, sf_dir):
    return gloss.examples(gloss.texts_of(_by_lang(spark, sf_dir), "lang"), "lang").select("lang", "rank", F.sha2("text", 256).alias("digest"))


def definitions_by_language(spark, sf_dir):
    return gloss.learn_definition(_by_lang(spark, sf_dir), "lang").select("lang", "definition", _r("confidence").alias("confidence"), "observation_count", F.size("examples").alias("n_examples"))


def ngram_embeddings(spark, sf_dir):
    """Hashed 3-grams of every text, 32 cells a document."""
    ship(spark)
    docs = table(spark, sf_dir, "documents").where("text <> ''")
    return docs.select("doc_id", F.posexplode(txt.hashed_ngrams("text")).alias("cell", "v")).select("doc_id", "cell", _r("v").alias("v"))


def fallback_embeddings(spark, sf_dir):
    """Vectors of the observations that have a text and no embedding, as the learner takes them, beside the widths of the others."""
    ship(spark)
    rows = table(spark, sf_dir, "observations").where("text <> '' or size(embedding) > 0")
    given = F.coalesce("embedding", F.array().cast("array<double>"))
    rows = rows.select("ord", (F.size(given) == 0).alias("from_text"), txt.ensure_embedding(given, F.col("text"), F.col("observation_id")).alias("v"))
    cells = rows.where("from_text").select("ord", F.posexplode("v").alias("cell", "x")).select("ord", "cell", _r("x").alias("x"))
    return cells.unionByName(rows.where("not from_text").select("ord", F.lit(-1).alias("cell"), F.size("v").cast("double").alias("x")))


# ---- sources and sinks


def observations_from_jsonl(spark, sf_dir):
    """The observations written as JSONL, with comments and blank lines, and read again."""
    ship(spark)
    fine = F.expr("filter(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    rows = table(spark, sf_dir, "observations").select(F.coalesce("observation_id", F.concat(F.lit("ord-"), "ord")).alias("observation_id"), fine.alias("embedding"), "text", F.struct("ord").alias("metadata"))
    folder = scratch_path(spark, "jsonl")
    rows.select(F.explode(F.array(F.lit("# observation"), F.lit(" "), F.to_json(F.struct(*rows.columns)))).alias("value")).write.text(folder)
    back = load_observations_jsonl(spark, folder)
    number = F.get_json_object("metadata", "$.ord").cast("bigint").alias("ord")
    return back.select(number, "observation_id", F.size("embedding").alias("width"), _r(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.sha2("text", 256).alias("digest"))


def stream_from_json(spark, sf_dir):
    """The codes that occur in the streams, written as one JSON document and read as a stream."""
    ship(spark)
    codes = table(spark, sf_dir, "stream_codes").where("code is not null").select("code")
    folder = scratch_path(spark, "stream")
    kept = codes.groupBy("code").count().groupBy().agg(F.to_json(F.struct(F.sort_array(F.collect_list("code")).alias("codes"))).alias("value"))  # one number for each code
    kept.coalesce(1).write.text(folder)
    return load_stream(spark, folder)


def pack_round_trip(spark, sf_dir):
    """The labels of the embeddings as a pack, saved, loaded and sealed again."""
    ship(spark)
    rows, protos = _prototypes(spark, sf_dir)
    none = F.array().cast("array<string>")
    symbols = protos.select(
        F.lit("labels").alias("pack_id"), F.col("class_id").alias("pos"), "class_id", F.col("class_id").alias("code"), "proto_embedding", F.array(F.concat(F.lit("é-"), "class_id")).alias("observation_ids"),
        F.concat(F.lit(" class "), "class_id").alias("definition"), none.alias("examples"), F.lit(0.5).alias("confidence"), (F.col("class_id") % 2 == 1).alias("quarantined"), F.lit(1.0).alias("survival"),
        F.struct(F.lit(0.5).alias("kappa"), F.col("size").cast("int").alias("size")).alias("metadata"),
    )
    pack = SymbolPack("labels", written(symbols, "symbols"), symbols.select("pack_id", "pos", "code", "class_id"), spark.createDataFrame([("labels", 0, 99, 1)], schemas.ALIAS), reconstruction_error=0.25).seal()
    path = Path(tempfile.mkdtemp(prefix="tessera-pack-")) / "pack.json"  # the interchange form is a file of the driver
    try:
        save_pack(pack, path)
        back = load_pack(spark, path)
    finally:
        shutil.rmtree(path.parent)
    out = back.symbols.select("class_id", "code", F.element_at("observation_ids", 1).alias("id"), "definition", "quarantined", F.col("metadata.size").alias("size"), _r(F.aggregate("proto_embedding", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))
    return out.withColumn("sealed", F.lit(back.checksum == pack.checksum == back.compute_checksum()))


# ---- geometry


def symbol_energy(spark, sf_dir):
    """Each symbol against the observations it was learned from: cosine, distances and energy."""
    usable = F.expr("size(v) = 64 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    seen = table(spark, sf_dir, "observations").where("observation_id is not null").select("observation_id", "ord", F.col("embedding").alias("v")).where(usable)
    seen = seen.groupBy("observation_id").agg(F.min(F.struct("ord", "v")).getField("v").alias("v"))
    symbols = unique_symbols(spark, sf_dir).select("symbol_id", "pack_id", "proto_embedding", F.col("metadata.kappa").alias("kappa"), F.explode(F.array_distinct("observation_ids")).alias("observation_id"))
    packs = last_packs(spark, sf_dir).select("pack_id", F.coalesce("reconstruction_error", F.lit(0.0)).alias("residual"))
    rows = symbols.join(packs, "pack_id").join(seen, "observation_id")
    return rows.select(
        "symbol_id", "observation_id", _r(vec.cosine_similarity("v", "proto_embedding")).alias("cosine"), _r(vec.cosine_distance("v", "proto_embedding")).alias("cosine_distance"),
        _r(vec.euclidean_distance("v", "proto_embedding")).alias("distance"), _r(vec.energy("v", "proto_embedding", F.col("kappa"), F.col("residual"))).alias("energy"),
    )


def capped_confidence(spark, sf_dir):
    symbols = unique_symbols(spark, sf_dir).join(last_packs(spark, sf_dir).select("pack_id", "reconstruction_error"), "pack_id")
    residual = F.coalesce("reconstruction_error", F.lit(0.0))
    return symbols.select("symbol_id", _r(vec.confidence_cap(F.col("confidence"), residual)).alias("capped"), vec.is_finite(F.col("reconstruction_error")).alias("finite"), txt.normal_definition(F.col("definition")).alias("definition"))


def _prototypes(spark, sf_dir):
    rows = _unit_table(spark, sf_dir).where("class_id is not null")
    return rows, written(learn.prototypes_of(rows, "class_id"), "prototypes")


def prototypes(spark, sf_dir):
    _, protos = _prototypes(spark, sf_dir)
    return protos.select("class_id", F.posexplode("proto_embedding").alias("at", "x")).select("class_id", "at", _r("x").alias("x"))


def class_quality(spark, sf_dir):
    """Size, coherence, quarantine and members of every label of the embeddings."""
    rows, protos = _prototypes(spark, sf_dir)
    seen = rows.join(protos.select("class_id", "proto_embedding"), "class_id").withColumn("cosine", vec.cosine_similarity("embedding", "proto_embedding"))
    classes = learn.class_table(seen)
    cfg = learn.LearnConfig()
    return classes.select("class_id", "size", _r("kappa").alias("kappa"), learn.quarantined(F.col("size"), F.col("kappa"), cfg).alias("quarantined"), F.array_join("observation_ids", ",").alias("ids"))


def nearest_prototype(spark, sf_dir):
    """The nearest label mean of every vector."""
    ship(spark)
    rows, protos = _prototypes(spark, sf_dir)
    listed = protos.orderBy("class_id").collect()  # one row for each label
    found = clustering.assign(clustering.matrix(rows), learn.as_array([r["proto_embedding"] for r in listed]))
    names = F.array(*(F.lit(r["class_id"]) for r in listed))
    return found.select(F.col("ord").alias("vec_id"), F.element_at(names, F.col("class_id") + 1).alias("class_id"), _r("distance2").alias("distance2"))


def alphabet_figures(spark, sf_dir):
    """Residual, description length and guards of the labels taken as an alphabet."""
    ship(spark)
    rows, protos = _prototypes(spark, sf_dir)
    error = vec.euclidean_distance("embedding", "proto_embedding")
    seen = rows.join(protos.select("class_id", "proto_embedding"), "class_id").select("class_id", vec.cosine_similarity("embedding", "proto_embedding").alias("cosine"), (error * error).alias("error2"), F.pow(vec.norm(F.col("embedding")), 2).alias("norm2"))
    seen = written(seen, "seen")
    sums = seen.agg(F.count("*").alias("n"), F.countDistinct("class_id").cast("int").alias("k"), F.avg("cosine").alias("kappa")).first()
    svd = clustering.svd_residual(clustering.matrix(rows), sums["k"], sums["n"])
    residual = learn.operational_residual(clustering.reconstruction_error(seen), svd)
    bits = spark.range(1).select(vec.mdl_bits(F.lit(sums["k"]), F.lit(residual), F.lit(64), F.lit(sums["n"]), F.lit(100))).first()[0]
    guards = learn.guard_values(sums["kappa"], residual, 0.0, 1.0, False, True, learn.LearnConfig())
    row = (round(residual, 6), sums["n"], sums["k"], round(sums["kappa"], 6), round(bits, 3), *(guards[g] for g in ("pass_kappa", "pass_residual", "pass_mdl", "pass_persist", "pass_compat", "pass_all")), learn.decide(guards))
    return spark.createDataFrame([row], "residual double, n bigint, k int, kappa double, bits double, pass_kappa boolean, pass_residual boolean, pass_mdl boolean, pass_persist boolean, pass_compat boolean, pass_all boolean, decision string")


def farthest_first(spark, sf_dir):
    ship(spark)
    ords, _ = clustering.farthest_first(clustering.matrix(_unit_table(spark, sf_dir)), 4)
    return spark.createDataFrame([(k + 1, o) for k, o in enumerate(ords)], "rank int, vec_id bigint")


def kmeans_labels(spark, sf_dir):
    """Class of every vector after k-means into 8 classes."""
    ship(spark)
    rows = _unit_table(spark, sf_dir)
    labels, _, _ = clustering.kmeans(clustering.matrix(rows), 8, rows.count())
    return labels.select(F.col("ord").alias("vec_id"), "class_id")


def svd_residual(spark, sf_dir):
    ship(spark)
    rows = _unit_table(spark, sf_dir)
    x, n = clustering.matrix(rows), rows.count()
    return spark.createDataFrame([(r, round(clustering.svd_residual(x, r, n), 6)) for r in (1, 8, 32, 64)], "rank int, residual double")


# ---- evolution


def _generations(spark, sf_dir):
    """Symbols of every pack beside those of its parent."""
    clean = lambda c: F.lower(F.trim(F.col(c)))
    link = last_packs(spark, sf_dir).select("pack_id", clean("parent_pack_id").alias("parent"))
    symbols = unique_symbols(spark, sf_dir).where("size(proto_embedding) = 64").select("pack_id", "pos", "code", "class_id", "proto_embedding")
    old = link.join(symbols.withColumnRenamed("pack_id", "parent").withColumn("parent", clean("parent")), "parent").drop("parent")
    return evolution.similarities(old, symbols, ["pack_id"])


def prototype_survival(spark, sf_dir):
    return evolution.survival(_generations(spark, sf_dir), ["pack_id"]).select("pack_id", "class_id", _r("survival").alias("survival"))


def alias_matching(spark, sf_dir):
    ship(spark)
    return evolution.match_aliases(_generations(spark, sf_dir), by=["pack_id"])


# ---- dynamics


def event_transitions(spark, sf_dir):
    """Transition matrix of event types by user."""
    events = table(spark, sf_dir, "events")
    rank = F.dense_rank().over(Window.orderBy("event_type")) - 1
    kinds = written(events.select("event_type").distinct().withColumn("class_id", rank), "kinds")  # a handful of types
    codes = events.join(kinds, "event_type")
    counts = dynamics.bigrams(codes.withColumn("o", F.struct("ts", "event_id")), "user_id", "o", "class_id")
    return dynamics.transition_matrix(kinds.select("class_id"), counts).select("src", "dst", _r("p").alias("p"))


def tilted_transitions(spark, sf_dir):
    """The uniform matrix of every pack, tilted by the energy of its symbols."""
    own = written(first_by(unique_symbols(spark, sf_dir), "class_id").select("pack_id", "class_id", "proto_embedding", "confidence"), "symbols")
    residual = last_packs(spark, sf_dir).select("pack_id", F.coalesce("reconstruction_error", F.lit(0.0)).alias("residual"))
    own = own.join(residual, "pack_id")
    base = dynamics.uniform(own.select("pack_id", "class_id"), ["pack_id"])
    return dynamics.tilted(base, own, F.col("residual"), 2.0, by=["pack_id"]).select("pack_id", "src", "class_id", _r("p").alias("p"))


def observed_dynamics(spark, sf_dir):
    """Transitions after each symbol of one small pack, through the class: its matrix from bigrams of its own codes, tilted."""
    ship(spark)
    symbols = [
        (c, c, [1.0 if k == c else 0.1 * k for k in range(4)], [f"o{c}"], f"class {c}", [], 0.2 * (c + 1), c == 2, 1.0, None) for c in range(4)
    ]
    symbols = spark.createDataFrame([("p", k, *s) for k, s in enumerate(symbols)], schemas.SYMBOL)
    none = spark.createDataFrame([], schemas.CODEBOOK)
    pack = SymbolPack("p", symbols, none, spark.createDataFrame([], schemas.ALIAS), reconstruction_error=0.25)
    counts = dynamics.bigrams(table(spark, sf_dir, "stream_codes").where("code is not null").select("stream_id", F.struct("pos", "arrived_at", "code").alias("o"), (F.col("code") % 5).alias("code")), "stream_id", "o")
    told = dynamics.SubjectiveSymbolDynamics(pack, beta_s=1.5)
    told.update_from_bigrams(counts)
    rows = [(prev, c, round(p, 6)) for prev in (0, 1, 2, 3, 99) for c, p in told.transition_probs(prev, [1.0, 0.0, 0.0, 0.5]).items()]
    return spark.createDataFrame(rows, "src int, class_id int, p double")


# ---- learning


def _learned(spark, sf_dir):
    """Alphabets of 8 and 12 symbols, learned from the embeddings and from the observations with usable vectors."""
    ship(spark)
    none = F.lit(None).cast("string")
    yield "embeddings", learn.learn_pack(_unit_table(spark, sf_dir).withColumn("text", none), pack_id="embeddings")
    usable = F.expr("size(embedding) = 64 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    rows = table(spark, sf_dir, "observations").where(usable).select("ord", F.coalesce("observation_id", F.concat(F.lit("ord-"), "ord")).alias("observation_id"), "embedding", "text")
    yield "observations", learn.learn_pack(rows, config=learn.LearnConfig(n_symbols=12), pack_id="observations")


def _symbols_of(pack):
    ids = F.sha2(F.array_join("observation_ids", ","), 256).alias("ids")
    return pack.symbols.select("class_id", "code", F.col("metadata.size").alias("size"), _r("metadata.kappa", 4).alias("kappa"), "quarantined", "definition", _r("confidence").alias("confidence"), ids)


def learn_embeddings(spark, sf_dir):
    return _symbols_of(next(pack for name, pack in _learned(spark, sf_dir) if name == "embeddings"))


def learn_observations(spark, sf_dir):
    return _symbols_of(next(pack for name, pack in _learned(spark, sf_dir) if name == "observations"))


def learn_guards(spark, sf_dir):
    """Residual, description length, guards, receipts and decision of both alphabets."""
    rows = []
    for name, pack in _learned(spark, sf_dir):
        g = pack.guards
        done = ",".join(f"{r.step}:{str(r.ok).lower()}" for r in pack.receipts if r.step != "factorization")
        rows.append((name, round(pack.reconstruction_error, 5), round(pack.mdl_bits, 0), round(g.kappa_avg, 4), g.pass_kappa, g.pass_residual, g.pass_mdl, g.pass_persist, g.pass_compat, g.pass_all, pack.metadata["decision"], done, _residual_ok(pack)))
    return spark.createDataFrame(rows, "alphabet string, residual double, bits double, kappa double, pass_kappa boolean, pass_residual boolean, pass_mdl boolean, pass_persist boolean, pass_compat boolean, pass_all boolean, decision string, receipts string, residual_ok boolean")


def _residual_ok(pack) -> bool:
    return cert.certify(pack.header, pack.symbols, pack.codebook, pack.aliases).first()["residual_ok"]


def learn_generations(spark, sf_dir):
    """The embeddings learned twice, 8 symbols and then 6 with the first as parent: survival and aliases of the second."""
    ship(spark)
    rows = _unit_table(spark, sf_dir).withColumn("text", F.lit(None).cast("string"))
    first = learn.learn_pack(rows, pack_id="first")
    second = learn.learn_pack(rows, config=learn.LearnConfig(n_symbols=6), previous=first, pack_id="second")
    told = second.aliases.select(F.col("new_code").alias("class_id"), "old_code")
    return second.symbols.select("class_id", _r("survival", 5).alias("survival")).join(told, "class_id", "left")


QUERIES = {f.__name__: f for f in (
    translate_packs, translate_codes, translate_streaming, stream_deduplicated, stream_windows, rewrite_codes, alias_closure, alias_follow, alias_follow_default, alias_cycles, dangling_aliases, code_lookup, class_lookup, live,
    pack_checksums, certify_packs, token_counts, keywords_by_language, examples_by_language, definitions_by_language, ngram_embeddings, fallback_embeddings, observations_from_jsonl, stream_from_json, pack_round_trip, symbol_energy, capped_confidence,
    prototypes, class_quality, nearest_prototype, alphabet_figures, farthest_first, kmeans_labels, svd_residual, prototype_survival, alias_matching, event_transitions,
    tilted_transitions, observed_dynamics, learn_embeddings, learn_observations, learn_guards, learn_generations,
)}

# ---- SQL

_BLANK = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(x):
    return f"regexp_replace(regexp_replace({x}, '^{_BLANK}+', ''), '{_BLANK}+$', '')"


_STOP = ", ".join(f"'{w}'" for w in txt.STOP_WORDS)
_PACKS = """
sym AS (SELECT DISTINCT ON (symbol_id) * FROM symbols),
pk AS (SELECT pack_id, arg_max(x, loaded_at) AS x FROM (SELECT pack_id, loaded_at, {'checksum': checksum, 'parent': parent_pack_id, 'r': reconstruction_error} AS x FROM symbol_packs WHERE pack_id IS NOT NULL) GROUP BY pack_id),
al AS (SELECT pack_id, old_code, arg_max(new_code, pos) AS new_code, max(pos) AS pos FROM pack_aliases GROUP BY ALL),
cb AS (SELECT pack_id, code, arg_max(class_id, pos) AS class_id, min(pos) AS pos FROM codebook GROUP BY ALL),
walk AS (
  SELECT pack_id, old_code, old_code AS cur, CAST([] AS INTEGER[]) AS seen, 0 AS hops FROM al
  UNION ALL
  SELECT w.pack_id, w.old_code, a.new_code, list_append(w.seen, w.cur), w.hops + 1 FROM walk w JOIN al a ON a.pack_id = w.pack_id AND a.old_code = w.cur WHERE NOT list_contains(w.seen, w.cur)),
clo AS (SELECT pack_id, old_code, arg_max(cur, hops) AS resolved_code, list_contains(arg_max(seen, hops), arg_max(cur, hops)) AS cyclic FROM walk GROUP BY ALL),
fc AS (SELECT * FROM sym QUALIFY row_number() OVER (PARTITION BY pack_id, class_id ORDER BY pos) = 1),
fk AS (SELECT * FROM sym QUALIFY row_number() OVER (PARTITION BY pack_id, code ORDER BY pos) = 1),
bc AS (
  SELECT k.pack_id, k.code, coalesce(c.symbol_id, d.symbol_id) AS symbol_id
  FROM (SELECT pack_id, code FROM cb UNION SELECT pack_id, code FROM fk) k
  LEFT JOIN cb ON cb.pack_id = k.pack_id AND cb.code = k.code
  LEFT JOIN fc c ON c.pack_id = k.pack_id AND c.class_id = cb.class_id
  LEFT JOIN fk d ON d.pack_id = k.pack_id AND d.code = k.code
  WHERE coalesce(c.symbol_id, d.symbol_id) IS NOT NULL)
"""


def _gloss_sql(codes, columns, where=""):
    text = f"nullif({_strip('s.definition')}, '')"
    held = "coalesce(s.quarantined, false)"
    return f"""SELECT {columns},
  CASE WHEN s.symbol_id IS NULL THEN 'unknown' WHEN {held} THEN 'quarantined' WHEN c.resolved_code IS NOT NULL THEN 'aliased' ELSE 'ok' END AS state,
  s.class_id, CASE WHEN s.symbol_id IS NOT NULL THEN coalesce(c.resolved_code, t.code) END AS resolved_code,
  round(CASE WHEN s.symbol_id IS NULL OR {held} OR {text} IS NULL THEN 0.0
    ELSE greatest(0.0, least(coalesce(s.confidence, 0.0), 1.0 - least(greatest(coalesce(p.x.r, 0.0), 0.0), 1.0))) END, 6) AS confidence
  FROM {codes} t LEFT JOIN clo c ON c.pack_id = t.pack_id AND c.old_code = t.code
  LEFT JOIN bc b ON b.pack_id = t.pack_id AND b.code = coalesce(c.resolved_code, t.code) LEFT JOIN sym s ON s.symbol_id = b.symbol_id
  LEFT JOIN pk p ON p.pack_id = t.pack_id"""


_ENGLISH = f"""CASE WHEN s.symbol_id IS NULL THEN '[undecodable: no symbol for code ' || t.code || ']'
  WHEN coalesce(s.quarantined, false) THEN '[quarantined: symbol ' || coalesce(c.resolved_code, t.code) || ' is not certified unfoldable]'
  WHEN nullif({_strip('s.definition')}, '') IS NULL THEN '[unglossed: symbol ' || coalesce(c.resolved_code, t.code) || ' has no bound English]'
  ELSE {_strip('s.definition')} END AS english"""
_STREAM = "picked AS (SELECT substr(md5(pack_id), 1, 2) AS bucket, min(pack_id) AS picked FROM symbols WHERE pack_id IS NOT NULL GROUP BY ALL)," + _PACKS.replace(
    "FROM pack_aliases GROUP BY ALL", "FROM (SELECT * FROM (SELECT picked AS pack_id FROM picked UNION SELECT min(pack_id) FROM symbols), stream_aliases) GROUP BY ALL"
)
_STREAM_CODES = "codes AS (SELECT coalesce(picked, (SELECT min(pack_id) FROM symbols)) AS pack_id, stream_id, pos, code FROM stream_codes LEFT JOIN picked ON bucket = substr(md5(stream_id), 1, 2))"
_EMB = """
e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label AS class_id FROM embeddings WHERE label IS NOT NULL),
cells AS (SELECT vec_id, class_id, generate_subscripts(v, 1) - 1 AS pl, unnest(v) AS x FROM e),
proto AS (SELECT class_id, list(x ORDER BY pl) AS p FROM (SELECT class_id, pl, avg(x) AS x FROM cells GROUP BY ALL) GROUP BY class_id)
"""
_TEXTS = f"""
t AS (SELECT lang, doc_id AS ord, {_strip('text')} AS text FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL),
texts AS (SELECT * FROM t WHERE text <> ''),
tok AS (SELECT lang, ord, generate_subscripts(w, 1) AS pl, unnest(w) AS token FROM (SELECT lang, ord, regexp_extract_all(lower(text), '[a-zA-Z][a-zA-Z0-9'']+') AS w FROM texts)),
kw AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, first) AS rank FROM (
    SELECT lang, token, count(*) AS n, min((ord, pl)) AS first FROM tok WHERE token NOT IN ({_STOP}) GROUP BY ALL)
  QUALIFY rank <= 8),
ex AS (SELECT lang, text, row_number() OVER (PARTITION BY lang ORDER BY ord) AS rank FROM texts QUALIFY rank <= 8)
"""
_SUMS = f"""WITH RECURSIVE {_PACKS},
syms AS (SELECT pack_id, string_agg('{{"class_id":' || class_id || ',"code":' || code || ',"definition":' || coalesce(CAST(to_json(nullif({_strip('definition')}, '')) AS VARCHAR), 'null')
   || ',"observation_ids":[' || coalesce(array_to_string(list_transform(observation_ids, lambda x: CAST(to_json(x) AS VARCHAR)), ','), '') || '],"quarantined":' || coalesce(quarantined, false) || '}}', ',' ORDER BY class_id, pos) AS s FROM sym GROUP BY pack_id),
cbs AS (SELECT pack_id, string_agg('"' || code || '":' || class_id, ',' ORDER BY CAST(code AS VARCHAR)) AS s FROM cb GROUP BY pack_id),
als AS (SELECT pack_id, string_agg('"' || old_code || '":' || new_code, ',' ORDER BY CAST(old_code AS VARCHAR)) AS s FROM al GROUP BY pack_id),
sums AS (
  SELECT p.pack_id, left(sha256('{{"aliases":{{' || coalesce(a.s, '') || '}},"codebook":{{' || coalesce(c.s, '') || '}},"pack_id":' || CAST(to_json(p.pack_id) AS VARCHAR)
    || ',"reconstruction_error":' || CAST(round(coalesce(p.x.r, 0.0), 8) AS VARCHAR) || ',"symbols":[' || coalesce(s.s, '') || ']}}'), 16) AS expected_checksum
  FROM pk p LEFT JOIN als a ON a.pack_id = p.pack_id LEFT JOIN cbs c ON c.pack_id = p.pack_id LEFT JOIN syms s ON s.pack_id = p.pack_id)
"""
_FAR = """WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s1 AS (SELECT vec_id, v FROM e ORDER BY list_inner_product(v, v) DESC, vec_id LIMIT 1),
d1 AS (SELECT e.vec_id, e.v, pow(list_distance(e.v, s1.v), 2) AS d FROM e, s1), s2 AS (SELECT vec_id, v FROM d1 ORDER BY d DESC, vec_id LIMIT 1),
d2 AS (SELECT d1.vec_id, d1.v, least(d1.d, pow(list_distance(d1.v, s2.v), 2)) AS d FROM d1, s2), s3 AS (SELECT vec_id, v FROM d2 ORDER BY d DESC, vec_id LIMIT 1),
d3 AS (SELECT d2.vec_id, d2.v, least(d2.d, pow(list_distance(d2.v, s3.v), 2)) AS d FROM d2, s3), s4 AS (SELECT vec_id, v FROM d3 ORDER BY d DESC, vec_id LIMIT 1)
SELECT 1 AS rank, vec_id FROM s1 UNION ALL SELECT 2, vec_id FROM s2 UNION ALL SELECT 3, vec_id FROM s3 UNION ALL SELECT 4, vec_id FROM s4"""

_COS = "CASE WHEN sqrt(list_inner_product({0}, {0})) < 1e-12 OR sqrt(list_inner_product({1}, {1})) < 1e-12 THEN 0.0 ELSE list_cosine_similarity({0}, {1}) END"
_VECTORS = "e AS (SELECT vec_id AS ord, CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS v, CAST(NULL AS VARCHAR) AS text FROM embeddings)"
_SEEN = "e AS (SELECT ord, coalesce(observation_id, 'ord-' || ord) AS id, embedding AS v, text FROM observations WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)"


def _kmeans(vectors, k):
    """Seeds, Lloyd passes and labels of e (ord, v): one row with all centroids for each pass."""
    return f"""{vectors},
seeds AS (
  SELECT 1 AS k, [arg_max(v, {{'a': list_inner_product(v, v), 'b': -ord}})] AS c FROM e
  UNION ALL
  SELECT s.k + 1, list_append(s.c, (SELECT arg_max(e.v, {{'a': list_min(list_transform(s.c, lambda q: pow(list_distance(e.v, q), 2))), 'b': -e.ord}}) FROM e)) FROM seeds s WHERE s.k < {k}),
km AS (
  SELECT 1 AS turn, c, c AS old, false AS done FROM seeds WHERE k = {k}
  UNION ALL
  SELECT turn + 1, CASE WHEN near THEN c ELSE moved END, c, near FROM (
    SELECT turn, c, moved, list_bool_and(list_transform(list_zip(flatten(moved), flatten(c)), lambda p: abs(p[1] - p[2]) <= 1e-8 + 1e-5 * abs(p[2]))) AS near
    FROM (SELECT km.turn, km.c, (
      SELECT list(coalesce(m.x, km.c[g.i]) ORDER BY g.i) FROM (SELECT unnest(range(1, {k} + 1)) AS i) g LEFT JOIN (
        SELECT l, list(x ORDER BY pl) AS x FROM (
          SELECT l, pl, avg(x) AS x FROM (
            SELECT l, generate_subscripts(v, 1) AS pl, unnest(v) AS x FROM (
              SELECT v, list_position(ds, list_min(ds)) AS l FROM (SELECT e.v, list_transform(km.c, lambda q: pow(list_distance(e.v, q), 2)) AS ds FROM e))) GROUP BY ALL) GROUP BY l) m ON m.l = g.i) AS moved
      FROM km WHERE NOT km.done AND km.turn <= 64))),
fin AS (SELECT arg_max(old, turn) AS labelling, arg_max(c, turn) AS c FROM km),
labels AS (SELECT ord, id, v, text, CAST(list_position(ds, list_min(ds)) - 1 AS INTEGER) AS class_id FROM (SELECT e.*, list_transform(fin.labelling, lambda q: pow(list_distance(e.v, q), 2)) AS ds FROM e, fin))"""


def _learn(vectors, k):
    """sy: the symbols of the alphabet; lb: the rows with their prototype."""
    return f"""{_kmeans(vectors, k)},
pr AS (SELECT CAST(i AS INTEGER) AS class_id, c[i + 1] AS p FROM fin, (SELECT unnest(range({k})) AS i)),
lb AS (SELECT labels.*, p FROM labels JOIN pr ON pr.class_id = labels.class_id),
cl AS (SELECT class_id, CAST(count(*) AS INTEGER) AS size, avg({_COS.format('v', 'p')}) AS kappa, string_agg(id, ',' ORDER BY ord) AS ids FROM lb GROUP BY class_id),
tx AS (SELECT class_id, ord, {_strip('text')} AS text FROM labels WHERE {_strip('text')} <> ''),
tk AS (SELECT class_id, ord, generate_subscripts(w, 1) AS pl, unnest(w) AS token FROM (SELECT class_id, ord, regexp_extract_all(lower(text), '[a-zA-Z][a-zA-Z0-9'']+') AS w FROM tx)),
kw AS (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY n DESC, first) AS rank FROM (SELECT class_id, token, count(*) AS n, min((ord, pl)) AS first FROM tk WHERE token NOT IN ({_STOP}) GROUP BY ALL) QUALIFY rank <= 8),
kc AS (SELECT class_id, count(*) AS k, string_agg(token, ', ' ORDER BY rank) FILTER (WHERE rank <= 4) AS head FROM kw GROUP BY class_id),
tc AS (SELECT class_id, count(*) AS m, arg_min(text, ord) AS t FROM tx GROUP BY class_id),
sy AS (
  SELECT class_id, p, size, kappa, held AS quarantined, ids, coalesce(nullif(d, ''), CASE WHEN held THEN '[quarantined class ' || class_id || ']' END) AS definition,
    CASE WHEN held THEN 0.0 ELSE conf END AS confidence
  FROM (SELECT pr.class_id, p, coalesce(size, 0) AS size, coalesce(kappa, 0.0) AS kappa, coalesce(size, 0) < 2 OR coalesce(kappa, 0.0) < 0.35 AS held, coalesce(ids, '') AS ids,
      CASE WHEN kc.k > 0 THEN 'Symbol for ' || head || '.' WHEN tc.t IS NOT NULL THEN 'Symbol attested by: ' || CASE WHEN length(tc.t) > 80 THEN left(tc.t, 77) || '...' ELSE tc.t END ELSE '' END AS d,
      CASE WHEN size IS NULL THEN 0.0 ELSE CAST(least(1.0, 0.25 + 0.15 * coalesce(m, 0) + 0.05 * coalesce(kc.k, 0)) AS DOUBLE) END AS conf
    FROM pr LEFT JOIN cl USING (class_id) LEFT JOIN kc USING (class_id) LEFT JOIN tc USING (class_id)))"""


_SYMBOLS = "SELECT class_id, class_id AS code, size, round(kappa, 4) AS kappa, quarantined, definition, round(confidence, 6) AS confidence, sha256(ids) AS ids FROM sy"
# the residual of k centroids is never below that of the best k directions, so a quarter of the latter plays no part
_GUARDS = """SELECT round(r, 5) AS residual, round(bits, 0) AS bits, round(kappa, 4) AS kappa, pass_kappa, pass_residual, true AS pass_mdl, true AS pass_persist, true AS pass_compat, pass_kappa AND pass_residual AS pass_all,
  CASE WHEN pass_kappa AND pass_residual THEN 'accept' WHEN pass_residual THEN 'accept_provisional' ELSE 'reject' END AS decision, 'clustering:true,finalize:' || pass_residual AS receipts, pass_residual AS residual_ok
FROM (SELECT *, kappa >= 0.35 AS pass_kappa, r <= 0.55 AS pass_residual, k * log2(greatest(k, 2)) + r * 64 * n + chars * 8 / 32.0 AS bits FROM (
  SELECT sqrt(sum(pow(list_distance(v, p), 2)) / sum(list_inner_product(v, v))) AS r, count(*) AS n, (SELECT count(*) FROM sy) AS k, (SELECT avg(kappa) FROM sy) AS kappa, (SELECT sum(coalesce(length(definition), 0)) FROM sy) AS chars FROM lb))"""
#: cand (grp, i, old_code, c): the candidates of each old symbol, best first; each takes its first that is not yet taken.
_GREEDY = """greedy AS (
  SELECT grp, CAST(0 AS BIGINT) AS i, CAST(NULL AS INTEGER) AS old_code, CAST(NULL AS INTEGER) AS new_code, CAST([] AS INTEGER[]) AS taken FROM (SELECT DISTINCT grp FROM cand)
  UNION ALL
  SELECT grp, i, old_code, pick.code, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick.class) END FROM (
    SELECT w.grp, n.i, n.old_code, w.taken, list_filter(n.c, lambda x: NOT list_contains(w.taken, x.class))[1] AS pick FROM greedy w JOIN cand n ON n.grp = w.grp AND n.i = w.i + 1))"""

_NGRAMS = """d AS (SELECT {id}, '^' || lower(text) || '$' AS b FROM {source}),
g AS (SELECT {id}, substr(b, i, 3) AS g FROM (SELECT {id}, b, unnest(range(1, length(b) - 1)) AS i FROM d)),
k AS (SELECT g, CAST('0x' || substr(sha256(g), 1, 2) AS INTEGER) % 32 AS cell, CASE WHEN CAST('0x' || substr(sha256(g), 9, 2) AS INTEGER) % 2 = 0 THEN 1 ELSE -1 END AS s FROM (SELECT DISTINCT g FROM g)),
v AS (SELECT {id}, cell, sum(s) AS v FROM g JOIN k USING (g) GROUP BY ALL),
l AS (SELECT {id}, sqrt(sum(v * v)) AS l FROM v GROUP BY {id}),
c AS (SELECT {id}, CAST(unnest(range(32)) AS INTEGER) AS cell FROM d),
grams AS (SELECT c.{id}, c.cell, round(coalesce(v.v, 0) / CASE WHEN l.l > 0 THEN l.l ELSE 1 END, 6) AS v FROM c LEFT JOIN v ON v.{id} = c.{id} AND v.cell = c.cell LEFT JOIN l ON l.{id} = c.{id})"""

SQL = {
    "translate_packs": f"""WITH RECURSIVE {_PACKS},
codes AS (SELECT pack_id, code FROM cb UNION SELECT pack_id, old_code FROM al UNION SELECT pack_id, code FROM sym UNION SELECT pack_id, 999999 FROM pk)
{_gloss_sql('codes', f"t.pack_id, t.code, {_ENGLISH}, p.x.checksum AS pack_checksum, coalesce(len(s.observation_ids), 0) AS n_ids")}""",
    "translate_codes": f"""WITH RECURSIVE {_STREAM},
{_STREAM_CODES}
{_gloss_sql('codes', 't.stream_id, t.pos, t.code')}""",
    "translate_streaming": f"""WITH RECURSIVE {_STREAM},
{_STREAM_CODES}
{_gloss_sql('codes', 't.stream_id, t.pos, t.code')}""",
    "stream_deduplicated": "SELECT DISTINCT stream_id, pos FROM stream_codes",
    "stream_windows": """WITH h AS (SELECT date_trunc('hour', arrived_at) AS begin, code FROM stream_codes), closed AS (SELECT max(date_trunc('millisecond', arrived_at)) - INTERVAL 1 DAY AS upto FROM stream_codes)
SELECT begin, code, count(*) AS n FROM h, closed WHERE begin + INTERVAL 1 HOUR <= upto GROUP BY begin, code""",
    "rewrite_codes": """WITH a AS (SELECT old_code, arg_max(new_code, pos) AS new_code FROM stream_aliases GROUP BY old_code)
SELECT stream_id, pos, coalesce(new_code, code) AS code, arrived_at FROM stream_codes LEFT JOIN a ON old_code = code""",
    "alias_closure": f"WITH RECURSIVE {_PACKS} SELECT * FROM clo",
    "alias_follow": f"""WITH RECURSIVE {_PACKS.replace("WHERE NOT list_contains(w.seen, w.cur)", "WHERE NOT list_contains(w.seen, w.cur) AND w.hops < 3")}
SELECT pack_id, old_code, resolved_code AS reached_code FROM clo""",
    "alias_follow_default": f"""WITH RECURSIVE {_PACKS.replace("WHERE NOT list_contains(w.seen, w.cur)", "WHERE NOT list_contains(w.seen, w.cur) AND w.hops < 64")}
SELECT pack_id, old_code, resolved_code AS reached_code FROM clo""",
    "alias_cycles": f"WITH RECURSIVE {_PACKS} SELECT pack_id, bool_or(cyclic) AS has_cycle FROM clo GROUP BY pack_id",
    "dangling_aliases": f"""WITH RECURSIVE {_PACKS} SELECT pack_id, old_code, new_code FROM al WHERE NOT EXISTS (SELECT 1 FROM cb WHERE cb.pack_id = al.pack_id AND cb.code = al.new_code)""",
    "code_lookup": f"WITH RECURSIVE {_PACKS} SELECT b.pack_id, b.code, s.class_id, s.code AS own_code FROM bc b JOIN sym s ON s.symbol_id = b.symbol_id",
    "class_lookup": f"WITH RECURSIVE {_PACKS} SELECT pack_id, class_id, symbol_id FROM fc",
    "live": f"WITH RECURSIVE {_PACKS} SELECT symbol_id, pack_id, class_id FROM sym WHERE NOT coalesce(quarantined, false)",
    "pack_checksums": f"{_SUMS} SELECT * FROM sums",
    "certify_packs": f"""{_SUMS},
bad AS (
  SELECT cb.pack_id, 'addressable' AS gate, 1 AS rank, cb.pos, format('code {{}} maps to missing class {{}}', cb.code, cb.class_id) AS m FROM cb WHERE NOT EXISTS (SELECT 1 FROM sym s WHERE s.pack_id = cb.pack_id AND s.class_id = cb.class_id)
  UNION ALL SELECT s.pack_id, 'addressable', 2, s.pos, format('symbol class {{}} code {{}} missing from codebook', s.class_id, s.code) FROM sym s WHERE NOT EXISTS (SELECT 1 FROM cb WHERE cb.pack_id = s.pack_id AND cb.code = s.code AND cb.class_id IS NOT NULL)
  UNION ALL SELECT s.pack_id, 'addressable', 2, s.pos, format('code {{}} codebook class {{}} != symbol class {{}}', s.code, cb.class_id, s.class_id) FROM sym s JOIN cb ON cb.pack_id = s.pack_id AND cb.code = s.code WHERE cb.class_id <> s.class_id
  UNION ALL SELECT pack_id, 'addressable', 3, 0, 'alias map contains a cycle' FROM clo GROUP BY pack_id HAVING bool_or(cyclic)
  UNION ALL SELECT al.pack_id, 'addressable', 4, al.pos, format('alias {{}}->{{}} does not resolve to a symbol', al.old_code, al.new_code) FROM al JOIN clo c ON c.pack_id = al.pack_id AND c.old_code = al.old_code WHERE NOT EXISTS (SELECT 1 FROM bc WHERE bc.pack_id = al.pack_id AND bc.code = c.resolved_code)
  UNION ALL SELECT pack_id, 'unfoldable', 5, pos, format('class {{}} has no observation_ids', class_id) FROM sym WHERE NOT coalesce(quarantined, false) AND coalesce(len(observation_ids), 0) = 0
  UNION ALL SELECT p.pack_id, 'gloss_bound', 6, 0, CASE WHEN coalesce(p.x.checksum, '') = '' THEN 'pack is unsealed (empty checksum)' ELSE 'checksum mismatch: gloss/pack mutated after sealing' END FROM pk p JOIN sums u ON u.pack_id = p.pack_id WHERE coalesce(p.x.checksum, '') <> u.expected_checksum
  UNION ALL SELECT pack_id, 'gloss_bound', 7, pos, format('class {{}} has no bound English gloss', class_id) FROM sym WHERE NOT coalesce(quarantined, false) AND nullif({_strip('definition')}, '') IS NULL
  UNION ALL SELECT pack_id, 'residual_ok', 8, 0, printf('reconstruction_error %.6f exceeds tau_residual 0.55', coalesce(x.r, 0.0)) FROM pk WHERE NOT (isfinite(coalesce(x.r, 0.0)) AND coalesce(x.r, 0.0) <= 0.55)),
f AS (SELECT pack_id, bool_or(gate = 'addressable') AS a, bool_or(gate = 'unfoldable') AS u, bool_or(gate = 'gloss_bound') AS g, bool_or(gate = 'residual_ok') AS r, string_agg(m, '; ' ORDER BY rank, pos, m) AS failures FROM bad GROUP BY pack_id)
SELECT p.pack_id, f.pack_id IS NULL AS passed, NOT coalesce(f.a, false) AS addressable, NOT coalesce(f.u, false) AS unfoldable, NOT coalesce(f.g, false) AS gloss_bound, NOT coalesce(f.r, false) AS residual_ok,
  coalesce(f.failures, '') AS failures,
  CAST((SELECT count(*) FROM sym s WHERE s.pack_id = p.pack_id) AS INTEGER) AS n_symbols, CAST((SELECT count(*) FROM sym s WHERE s.pack_id = p.pack_id AND NOT coalesce(quarantined, false)) AS INTEGER) AS n_live,
  CAST((SELECT count(*) FROM al WHERE al.pack_id = p.pack_id) AS INTEGER) AS n_aliases
FROM pk p LEFT JOIN f ON f.pack_id = p.pack_id""",
    "token_counts": f"""SELECT doc_id, len(w) AS n_tokens, len(list_filter(w, lambda x: x NOT IN ({_STOP}))) AS n_words
FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-zA-Z][a-zA-Z0-9'']+') AS w FROM documents WHERE text IS NOT NULL)""",
    "keywords_by_language": f"WITH {_TEXTS} SELECT lang, CAST(rank AS INTEGER) AS rank, token, n FROM kw",
    "examples_by_language": f"WITH {_TEXTS} SELECT lang, CAST(rank AS INTEGER) AS rank, sha256(text) AS digest FROM ex",
    "definitions_by_language": f"""WITH {_TEXTS},
n AS (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang), m AS (SELECT lang, count(*) AS m FROM texts GROUP BY lang),
k AS (SELECT lang, count(*) AS k, string_agg(token, ', ' ORDER BY rank) FILTER (WHERE rank <= 4) AS head FROM kw GROUP BY lang), x AS (SELECT lang, count(*) AS x, min(text) FILTER (WHERE rank = 1) AS t FROM ex GROUP BY lang)
SELECT n.lang, CASE WHEN k.k > 0 THEN 'Symbol for ' || head || '.' WHEN x.t IS NOT NULL THEN 'Symbol attested by: ' || CASE WHEN length(x.t) > 80 THEN left(x.t, 77) || '...' ELSE x.t END ELSE '' END AS definition,
  round(CAST(least(1.0, 0.25 + 0.15 * coalesce(m.m, 0) + 0.05 * coalesce(k.k, 0)) AS DOUBLE), 6) AS confidence, n.n AS observation_count, CAST(coalesce(x.x, 0) AS INTEGER) AS n_examples
FROM n LEFT JOIN m USING (lang) LEFT JOIN k USING (lang) LEFT JOIN x USING (lang)""",
    "symbol_energy": f"""WITH RECURSIVE {_PACKS},
o AS (SELECT observation_id, arg_min(embedding, ord) AS v FROM observations WHERE observation_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 GROUP BY observation_id),
r AS (SELECT DISTINCT symbol_id, pack_id, proto_embedding AS p, metadata.kappa AS kappa, unnest(observation_ids) AS observation_id FROM sym),
c AS (SELECT r.*, o.v, coalesce(pk.x.r, 0.0) AS residual, list_distance(o.v, r.p) AS d,
  CASE WHEN sqrt(list_inner_product(v, v)) < 1e-12 OR sqrt(list_inner_product(p, p)) < 1e-12 THEN 0.0 ELSE list_inner_product(v, p) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(p, p))) END AS cosine
  FROM r JOIN pk ON pk.pack_id = r.pack_id JOIN o ON o.observation_id = r.observation_id)
SELECT symbol_id, observation_id, round(cosine, 6) AS cosine, round(1 - cosine, 6) AS cosine_distance, round(d, 6) AS distance, round(0.40 * (1 - cosine) + 0.20 * (1 - kappa) + 0.10 * residual, 6) AS energy FROM c""",
    "capped_confidence": f"""WITH RECURSIVE {_PACKS}
SELECT s.symbol_id, round(greatest(0.0, least(s.confidence, 1.0 - least(greatest(coalesce(p.x.r, 0.0), 0.0), 1.0))), 6) AS capped, p.x.r IS NOT NULL AND isfinite(p.x.r) AS finite, nullif({_strip('s.definition')}, '') AS definition
FROM sym s JOIN pk p ON p.pack_id = s.pack_id""",
    "prototypes": f'WITH {_EMB} SELECT class_id, CAST(pl AS INTEGER) AS "at", round(avg(x), 6) AS x FROM cells GROUP BY class_id, pl',
    "class_quality": f"""WITH {_EMB}
SELECT e.class_id, CAST(count(*) AS INTEGER) AS size, round(avg(list_cosine_similarity(v, p)), 6) AS kappa, count(*) < 2 OR avg(list_cosine_similarity(v, p)) < 0.35 AS quarantined, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY vec_id) AS ids
FROM e JOIN proto ON proto.class_id = e.class_id GROUP BY e.class_id""",
    "nearest_prototype": f"""WITH {_EMB}
SELECT vec_id, class_id, round(d, 6) AS distance2 FROM (SELECT e.vec_id, proto.class_id, pow(list_distance(v, p), 2) AS d FROM e, proto) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, class_id) = 1""",
    "alphabet_figures": f"""WITH {_EMB},
s AS (SELECT sqrt(sum(pow(list_distance(v, p), 2)) / sum(list_inner_product(v, v))) AS r, count(*) AS n, count(DISTINCT e.class_id) AS k, avg(list_cosine_similarity(v, p)) AS kappa FROM e JOIN proto ON proto.class_id = e.class_id)
SELECT round(r, 6) AS residual, n, CAST(k AS INTEGER) AS k, round(kappa, 6) AS kappa, round(greatest(k, 1) * log2(greatest(k, 2)) + r * 64 * n + 25.0, 3) AS bits,
  kappa >= 0.35 AS pass_kappa, r <= 0.55 AS pass_residual, true AS pass_mdl, true AS pass_persist, true AS pass_compat, kappa >= 0.35 AND r <= 0.55 AS pass_all,
  CASE WHEN kappa >= 0.35 AND r <= 0.55 THEN 'accept' WHEN r <= 0.55 THEN 'accept_provisional' ELSE 'reject' END AS decision FROM s""",
    "farthest_first": _FAR,
    "prototype_survival": f"""WITH RECURSIVE {_PACKS},
g AS (SELECT p.pack_id, o.proto_embedding AS o FROM pk p JOIN sym o ON lower(trim(o.pack_id)) = lower(trim(p.x.parent)) WHERE len(o.proto_embedding) = 64),
c AS (SELECT n.pack_id, n.class_id, CASE WHEN sqrt(list_inner_product(o, o)) < 1e-12 OR sqrt(list_inner_product(n.proto_embedding, n.proto_embedding)) < 1e-12 THEN 0.0 ELSE list_cosine_similarity(o, n.proto_embedding) END AS s
  FROM g JOIN sym n ON n.pack_id = g.pack_id WHERE len(n.proto_embedding) = 64)
SELECT pack_id, class_id, round(greatest(max(s), 0.0), 6) AS survival FROM c GROUP BY ALL""",
    "event_transitions": """WITH k AS (SELECT event_type, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS c FROM (SELECT DISTINCT event_type FROM events)),
b AS (SELECT c AS src, lead(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events JOIN k USING (event_type)),
n AS (SELECT src, dst, count(*) AS n FROM b WHERE dst IS NOT NULL GROUP BY ALL)
SELECT x.c AS src, y.c AS dst, round(CASE WHEN sum(n.n) OVER w > 0 THEN coalesce(n.n, 0) / sum(n.n) OVER w ELSE 1.0 / count(*) OVER w END, 6) AS p
FROM k x CROSS JOIN k y LEFT JOIN n ON n.src = x.c AND n.dst = y.c WINDOW w AS (PARTITION BY x.c)""",
    "tilted_transitions": f"""WITH RECURSIVE {_PACKS},
s AS (SELECT fc.pack_id, class_id, greatest(coalesce(confidence, 0.0), 0.0) AS kappa, proto_embedding AS p, coalesce(pk.x.r, 0.0) AS r FROM fc JOIN pk ON pk.pack_id = fc.pack_id),
w AS (SELECT pack_id, class_id, exp(-2.0 * (0.40 * CASE WHEN sqrt(list_inner_product(p, p)) < 1e-12 THEN 1.0 ELSE 0.0 END + 0.20 * (1 - kappa) + 0.10 * r)) AS w FROM s)
SELECT a.pack_id, a.class_id AS src, b.class_id, round(b.w / sum(b.w) OVER (PARTITION BY a.pack_id, a.class_id), 6) AS p FROM w a JOIN w b ON b.pack_id = a.pack_id""",
    "ngram_embeddings": f"""WITH {_NGRAMS.format(id="doc_id", source="documents WHERE text <> ''")} SELECT * FROM grams""",
    "fallback_embeddings": f"""WITH {_NGRAMS.format(id="ord", source="observations WHERE coalesce(len(embedding), 0) = 0 AND text <> ''")}
SELECT ord, cell, v AS x FROM grams UNION ALL SELECT ord, -1, CAST(len(embedding) AS DOUBLE) FROM observations WHERE len(embedding) > 0""",
    "observations_from_jsonl": """SELECT ord, coalesce(observation_id, 'ord-' || ord) AS observation_id, CAST(coalesce(len(v), 0) AS INTEGER) AS width, round(coalesce(list_sum(v), 0.0), 4) AS total, sha256(text) AS digest
FROM (SELECT *, list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x)) AS v FROM observations)""",
    "stream_from_json": """SELECT row_number() OVER (ORDER BY code) - 1 AS pos, code FROM (SELECT DISTINCT code FROM stream_codes WHERE code IS NOT NULL)""",
    "pack_round_trip": f"""WITH {_EMB}
SELECT class_id, class_id AS code, 'é-' || class_id AS id, ' class ' || class_id AS definition, class_id % 2 = 1 AS quarantined, CAST(n AS INTEGER) AS size, round(list_sum(p), 5) AS total, true AS sealed
FROM proto JOIN (SELECT class_id, count(*) AS n FROM e GROUP BY class_id) USING (class_id)""",
    "kmeans_labels": f"""WITH RECURSIVE {_kmeans(_VECTORS, 8)}
SELECT ord AS vec_id, class_id FROM labels""",
    "learn_embeddings": f"""WITH RECURSIVE {_learn(_VECTORS, 8)} {_SYMBOLS}""",
    "learn_observations": f"""WITH RECURSIVE {_learn(_SEEN, 12)} {_SYMBOLS}""",
    "learn_guards": f"""SELECT 'embeddings' AS alphabet, * FROM (WITH RECURSIVE {_learn(_VECTORS, 8)} {_GUARDS})
UNION ALL SELECT 'observations', * FROM (WITH RECURSIVE {_learn(_SEEN, 12)} {_GUARDS})""",
    "learn_generations": f"""WITH a AS (SELECT class_id, p FROM (WITH RECURSIVE {_learn(_VECTORS, 8)} SELECT class_id, CASE WHEN size > 0 THEN p ELSE list_transform(p, lambda x: 0.0) END AS p FROM sy)),
b AS (SELECT class_id, p, kept FROM (WITH RECURSIVE {_learn(_VECTORS, 6)} SELECT class_id, p AS kept, CASE WHEN size > 0 THEN p ELSE list_transform(p, lambda x: 0.0) END AS p FROM sy)),
sims AS (SELECT a.class_id AS old, b.class_id AS new, {_COS.format('a.p', 'b.p')} AS sim, {_COS.format('a.p', 'b.kept')} AS lasting FROM a, b),
cand AS (SELECT CAST(0 AS INTEGER) AS grp, row_number() OVER (ORDER BY old) AS i, old AS old_code, list({{'class': new, 'code': new}} ORDER BY sim DESC, new) AS c FROM sims WHERE sim > 0.55 GROUP BY old),
told AS (SELECT * FROM (WITH RECURSIVE {_GREEDY} SELECT old_code, new_code FROM greedy WHERE new_code IS NOT NULL AND new_code <> old_code))
SELECT new AS class_id, round(greatest(max(lasting), 0.0), 5) AS survival, old_code FROM sims LEFT JOIN told ON new_code = new GROUP BY new, old_code""",
    "alias_matching": f"""WITH RECURSIVE {_PACKS},
g AS (SELECT p.pack_id, o.pos AS old_pos, o.code AS old_code, o.proto_embedding AS o FROM pk p JOIN sym o ON lower(trim(o.pack_id)) = lower(trim(p.x.parent)) WHERE len(o.proto_embedding) = 64),
sims AS (SELECT g.pack_id, old_pos, old_code, n.pos AS new_pos, n.code AS new_code, n.class_id, {_COS.format('o', 'n.proto_embedding')} AS sim FROM g JOIN sym n ON n.pack_id = g.pack_id WHERE len(n.proto_embedding) = 64),
cand AS (SELECT pack_id AS grp, row_number() OVER (PARTITION BY pack_id ORDER BY old_pos) AS i, min(old_code) AS old_code, list({{'class': class_id, 'code': new_code}} ORDER BY sim DESC, new_pos) AS c FROM sims WHERE sim > 0.55 GROUP BY pack_id, old_pos),
{_GREEDY},
told AS (SELECT grp AS pack_id, old_code, arg_max(new_code, i) AS new_code, min(i) AS i FROM greedy WHERE new_code IS NOT NULL AND new_code <> old_code GROUP BY ALL)
SELECT pack_id, CAST(row_number() OVER (PARTITION BY pack_id ORDER BY i) - 1 AS INTEGER) AS pos, old_code, new_code FROM told""",
    "observed_dynamics": """WITH s AS (SELECT c, [CASE WHEN k = c THEN 1.0 ELSE 0.1 * k END for k in [0, 1, 2, 3]] AS p, 0.2 * (c + 1) AS kappa FROM (SELECT unnest(range(4)) AS c)),
b AS (SELECT code % 5 AS src, lead(code % 5) OVER (PARTITION BY stream_id ORDER BY pos, arrived_at, code) AS dst FROM stream_codes WHERE code IS NOT NULL),
n AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS n FROM b WHERE src < 4 AND dst < 4 GROUP BY ALL),
m AS (SELECT x.c AS src, y.c AS dst, coalesce(CASE WHEN sum(n) OVER w > 0 THEN coalesce(n, 0) / sum(n) OVER w END, 0.25) AS p FROM s x CROSS JOIN s y LEFT JOIN n ON n.src = x.c AND n.dst = y.c WINDOW w AS (PARTITION BY x.c)
  UNION ALL SELECT 99, c, 0.25 FROM s),
t AS (SELECT src, dst, m.p * exp(-1.5 * (0.40 * (1 - list_cosine_similarity([1.0, 0.0, 0.0, 0.5], CAST(s.p AS DOUBLE[]))) + 0.20 * (1 - kappa) + 0.10 * 0.25)) AS w FROM m JOIN s ON s.c = dst)
SELECT CAST(src AS INTEGER) AS src, CAST(dst AS INTEGER) AS class_id, round(w / sum(w) OVER (PARTITION BY src), 6) AS p FROM t""",
}
