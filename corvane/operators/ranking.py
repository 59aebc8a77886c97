"""After retrieval: near-duplicate elimination, evidence scores, per-file diversity, role groups.

What a Column can say stays a Column. The two greedy loops look at a query's candidates in rank
order; they run per (query, path) or per query on at most a few hundred rows each, after top-k.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import lexical
from corvane.operators.lexical import QueryTerms

PER_FILE = 3
FEATURES = ["ranged", "flat", "line_set", "defines", "narrow_signature", "wide_signature", "auditable", "size"]


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Common lines of two ranges; negative if they are apart."""
    return F.least(e1, e2) - F.greatest(s1, s2) + 1


def close(a: Column, b: Column) -> Column:
    gap = F.abs(a - b)
    return (gap <= 1) | (gap / F.greatest(F.abs(a), F.abs(b), F.lit(1.0)) <= 0.2)


def with_features(results: DataFrame) -> DataFrame:
    """Columns that the duplicate and evidence rules need, computed once a row; rows that carry them stay as they are."""
    if set(FEATURES) <= set(results.columns):
        return results
    c = F.col("content")
    ranged = (F.col("start_line") > 0) & (F.col("end_line") >= F.col("start_line"))
    return (results.withColumn("ranged", ranged).withColumn("flat", T.squeezed(c)).withColumn("line_set", T.meaningful_lines(c)).withColumn("defines", T.definition_signatures(c))
            .withColumn("narrow_signature", T.signature(c, wide=False)).withColumn("wide_signature", T.signature(c, wide=True))
            .withColumn("auditable", F.when(F.col("ranged"), 2).otherwise(0) + F.when(F.col("narrow_signature").isNotNull(), 3).otherwise(0) + F.when(T.balanced_block(c), 1).otherwise(0))
            .withColumn("size", F.when(F.col("ranged"), F.col("end_line") - F.col("start_line") + 1).otherwise(F.char_length("flat"))))


def duplicate_pairs(results: DataFrame, by: list[str]) -> DataFrame:
    """(by..., a, b) of rows of one path that are near duplicates; rows carry id and the features. Equal paths join, nothing else meets."""
    f = with_features(results)
    cols = ["id", "start_line", "end_line", "ranged", "flat", "line_set", "defines", "narrow_signature", "size"]
    x = f.select(*by, "relative_path", *[F.col(c).alias(f"{c}_1") for c in cols])
    y = f.select(*by, "relative_path", *[F.col(c).alias(f"{c}_2") for c in cols])
    p = x.join(y, [*by, "relative_path"]).filter("id_1 < id_2")
    c = lambda n: (F.col(f"{n}_1"), F.col(f"{n}_2"))
    common = overlap(F.col("start_line_1"), F.col("end_line_1"), F.col("start_line_2"), F.col("end_line_2"))
    small, big = F.least(*c("size")), F.greatest(*c("size"))
    alike = T.line_jaccard(*c("line_set"))
    apart = F.greatest(*c("start_line")) - F.least(*c("end_line")) - 1
    same_start = F.coalesce(F.col("narrow_signature_1") == F.col("narrow_signature_2"), F.lit(False))
    by_range = F.col("ranged_1") & F.col("ranged_2") & F.when(common > 0, (common / small > 0.5) | (common / big >= 0.6)).otherwise((apart <= 2) & (small >= 4) & (same_start | (alike >= 0.6)))
    short = F.when(F.char_length("flat_1") <= F.char_length("flat_2"), F.col("flat_1")).otherwise(F.col("flat_2"))
    long = F.when(F.char_length("flat_1") <= F.char_length("flat_2"), F.col("flat_2")).otherwise(F.col("flat_1"))
    by_text = (short != "") & (((F.char_length(short) >= 80) & F.contains(long, short)) | ((F.col("flat_1") != F.col("flat_2")) & (alike >= 0.82)))
    return p.filter((by_range | by_text) & ~T.conflicting(*c("defines"))).select(*by, "relative_path", F.col("id_1").alias("a"), F.col("id_2").alias("b"))


def _prefer(new: dict, old: dict) -> bool:
    """Does the later of two duplicates take the place of the earlier one?"""
    def near(a, b):
        return abs(a - b) <= 1 or abs(a - b) / max(abs(a), abs(b), 1) <= 0.2
    if new["ranged"] != old["ranged"]:
        return bool(new["ranged"])
    if abs(new["auditable"] - old["auditable"]) >= 2:
        return new["auditable"] > old["auditable"]
    exact = [bool({"exact_filename", "exact_symbol_definition"} & set(r["reasons"] if r["reasons"] is not None else ())) for r in (new, old)]
    if exact[0] != exact[1]:
        return exact[0]
    starts = [r["narrow_signature"] is not None for r in (new, old)]
    tied = near(new["score"], old["score"])
    if starts[0] != starts[1] and tied:
        return starts[0]
    if new["score"] > old["score"]:
        return True
    return tied and 0 < new["size"] < 0.75 * old["size"]


def deduplicate(results: DataFrame) -> DataFrame:
    """Near-duplicate elimination in rank order within each (query, path).

    results: query_id, id, relative_path, content, start_line, end_line, score, rank, reasons. The
    pairs come from a join; the loop over one path's rows only decides who stays. Ties in rank go by id.
    """
    pairs = duplicate_pairs(results, ["query_id"])
    both = pairs.select("query_id", F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))).alias("p"))
    twins = both.groupBy("query_id", F.col("p.id").alias("id")).agg(F.collect_set("p.other").alias("twins"))
    rows = with_features(results).join(twins, ["query_id", "id"], "left")
    loose = rows.filter("twins is null").select("query_id", "id")
    tied = rows.filter("twins is not null").select("query_id", "relative_path", "id", "rank", "score", "ranged", "auditable", "reasons", "narrow_signature", "size", "twins")
    id_type = dict(results.dtypes)["id"]

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[dict] = []
        for row in pdf.sort_values(["rank", "id"]).to_dict("records"):
            twin, stays = set(row["twins"]), True
            for old in [k for k in kept if k["id"] in twin]:
                if not _prefer(row, old):
                    stays = False
                    break
                kept = [k for k in kept if k is not old]
            if stays:
                kept.append(row)
        return pd.DataFrame({"query_id": [r["query_id"] for r in kept], "id": [r["id"] for r in kept]}, columns=["query_id", "id"])

    picked = tied.groupBy("query_id", "relative_path").applyInPandas(decide, f"query_id {dict(results.dtypes)['query_id']}, id {id_type}")
    return results.join(loose.unionByName(picked), ["query_id", "id"], "left_semi")


def evidence(score: Column, reasons: Column, chunk_role: Column, signature: Column) -> Column:
    has = lambda r: F.coalesce(F.array_contains(reasons, r), F.lit(False))
    return (F.when(score > 0, F.log1p(score) * 120).otherwise(0.0) + F.when(has("exact_filename"), 420).otherwise(0) + F.when(has("exact_symbol_definition"), 360).otherwise(0)
            + F.when(has("path_match"), 180).otherwise(0) + F.when(chunk_role == "definition", 110).when(chunk_role == "method_body", 90).otherwise(0) + F.when(signature.isNotNull(), 90).otherwise(0))


def _strong(row: dict) -> bool:
    return row["wide_signature"] is not None or bool({"exact_symbol_definition", "exact_filename", "path_match"} & set(row["reasons"] if row["reasons"] is not None else ()))


def _sign(row: dict) -> str | None:
    if row["wide_signature"] is not None:
        return row["wide_signature"]
    found = sorted({"exact_symbol_definition", "exact_filename", "path_match"} & set(row["reasons"] if row["reasons"] is not None else ()))
    where = f"{row['start_line']}-{row['end_line']}" if row["ranged"] else "unknown-range"
    return f"{'+'.join(found)}:{row['chunk_role'] or 'unknown'}:{where}" if found else None


def _overlaps(a: dict, b: dict) -> bool:
    if not (a["ranged"] and b["ranged"]):
        return False
    common = min(a["end_line"], b["end_line"]) - max(a["start_line"], b["start_line"]) + 1
    return common > 0 and common / min(a["size"], b["size"]) > 0.2


def diversify(results: DataFrame, limit: int, per_file: int = PER_FILE, by: list[str] = ["query_id"]) -> DataFrame:
    """Up to `limit` rows for each key (a query's candidates after top-k, a few hundred at most), no more than per_file of a path, with their new order in `pick`.

    Files go by aggregate evidence: -40 for each rank that their best row stands behind, plus 0.35 of
    the evidence (260 at most each) of up to four distinct strong rows. First each file's best row,
    then rounds of distinct strong evidence, then what is left.
    results: query_id, id, relative_path, content, start_line, end_line, score, rank, reasons, chunk_role.
    """
    f = with_features(results).withColumn("evidence", evidence(F.col("score"), F.col("reasons"), F.col("chunk_role"), F.col("wide_signature")))
    narrow = f.select(*by, "id", "relative_path", "rank", "start_line", "end_line", "ranged", "size", "reasons", "chunk_role", "wide_signature", "evidence")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["rank", "id"]).to_dict("records")
        for i, r in enumerate(rows):
            r["order"] = i
        files: dict[str, list[dict]] = {}
        for r in rows:
            files.setdefault(r["relative_path"], []).append(r)

        def worth(own):
            total, chosen = -40.0 * own[0]["order"], [own[0]]
            for r in sorted(own[1:], key=lambda r: (-r["evidence"], r["order"])):
                distinct = _strong(r) and not any(_overlaps(r, c) for c in chosen) and _sign(r) is not None and all(_sign(r) != _sign(c) for c in chosen)
                if len(chosen) <= 4 and distinct:
                    total += min(0.35 * r["evidence"], 260.0)
                    chosen.append(r)
            return total

        ordered = sorted(files.values(), key=lambda own: (-worth(own), own[0]["order"]))
        picked: list[dict] = [own[0] for own in ordered]
        had = {own[0]["relative_path"]: [own[0]] for own in ordered}

        def take(r):
            picked.append(r)
            had[r["relative_path"]].append(r)

        for _ in range(1, per_file):
            before = len(picked)
            for own in ordered:
                mine = had[own[0]["relative_path"]]
                fresh = [r for r in own[1:] if r not in mine and _strong(r) and all(not _overlaps(r, c) and _sign(r) is not None and _sign(r) != _sign(c) for c in mine)]
                if len(mine) < per_file and fresh:
                    take(fresh[0])
            if len(picked) == before:
                break
        for own in ordered:
            for r in own:
                if r not in had[r["relative_path"]] and len(had[r["relative_path"]]) < per_file:
                    take(r)
        picked = picked[:limit]
        return pd.DataFrame({**{c: [r[c] for r in picked] for c in (*by, "id")}, "pick": range(1, len(picked) + 1)}, columns=[*by, "id", "pick"])

    types = dict(results.dtypes)
    chosen = narrow.groupBy(*by).applyInPandas(choose, ", ".join(f"{c} {types[c]}" for c in (*by, "id")) + ", pick int")
    return results.join(chosen, [*by, "id"])


def related_reserve(limit: Column, primary: Column, related: Column) -> Column:
    """How many of a query's `limit` places go to related results."""
    few = F.least(related, limit - primary)
    share = F.least(related, F.greatest(F.lit(1), F.floor(limit * 0.2).cast("int")), limit - 1)
    return F.when((limit <= 1) | (related == 0), 0).when(primary < limit, few).otherwise(share)


GROUPS = ["implementation", "entry_exports", "related_tests", "docs_config", "other"]


def result_group(role: Column) -> Column:
    return (F.when(role == "implementation", GROUPS[0]).when(role.isin("barrel", "entrypoint"), GROUPS[1]).when(role == "test", GROUPS[2])
            .when(role.isin("docs", "config", "style", "generated"), GROUPS[3]).otherwise(GROUPS[4]))


def group_and_pick(results: DataFrame, limit: int, target: str = "implementation") -> DataFrame:
    """Primary rows of the target role first, then reserved related rows: the first of each group in group order, then the rest by rank.

    results: query_id, id, rank, file_role. Adds result_group, is_primary and pick.
    """
    role = {"implementation": ["implementation"], "test": ["test"], "docs": ["docs"], "config": ["config"]}.get(target)
    primary = F.col("file_role").isin(role) if role else F.lit(True)
    q = Window.partitionBy("query_id")
    r = (results.withColumn("is_primary", primary).withColumn("result_group", result_group(F.col("file_role")))
         .withColumn("primaries", F.count_if("is_primary").over(q).cast("int")).withColumn("others", F.count_if(~F.col("is_primary")).over(q).cast("int"))
         .withColumn("reserve", related_reserve(F.lit(limit), F.col("primaries"), F.col("others"))))
    order = F.lit(len(GROUPS))
    for i, g in enumerate(GROUPS):
        order = F.when(F.col("result_group") == g, i).otherwise(order)
    r = r.withColumn("in_group", F.row_number().over(Window.partitionBy("query_id", "is_primary", "result_group").orderBy("rank", "id")))
    first = F.when(F.col("is_primary"), F.lit(0)).when(F.col("in_group") == 1, order).otherwise(len(GROUPS) + 1)
    r = r.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "is_primary").orderBy(first, "rank", "id")))
    kept = r.filter(F.when(F.col("is_primary"), F.col("place") <= limit - F.col("reserve")).otherwise(F.col("place") <= F.col("reserve")))
    return (kept.withColumn("pick", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("is_primary"), "place")))
            .drop("primaries", "others", "reserve", "in_group", "place"))


def in_group_order(results: DataFrame, terms: QueryTerms, target: str = "implementation") -> DataFrame:
    """Results with file role, group and sort keys of a query, and their order under these keys in `rank`.

    Primary rows (of the target's role; for implementation also of roles, extensions and paths that the
    query names) come first, then by role, owner signal, structure, score and the rank they had. With
    target `all` the order is anchors, structure, score, rank.
    results: query_id, id, rank, score, file_role, relative_path, content, reasons, chunk_role.
    """
    role, path, reasons = F.col("file_role"), F.col("relative_path"), F.col("reasons")
    named = lexical.explicitly_asked(role, path, terms) | lexical.names_path(path, terms)
    primary = {"implementation": named, "all": F.lit(True)}.get(target, role == target)
    order = F.lit(len(GROUPS) - 1)
    for i, g in enumerate(GROUPS[:-1]):
        order = F.when(F.col("result_group") == g, i).otherwise(order)
    by_role = F.when((role != "implementation") & named, 0).otherwise(order + 1) if target == "implementation" else F.when(F.col("is_primary"), 0).otherwise(order + 1)
    exact = F.arrays_overlap(reasons, F.array(F.lit("exact_filename"), F.lit("exact_symbol_definition")))
    out = (results.withColumn("result_group", result_group(role)).withColumn("is_primary", primary).withColumn("role_priority", by_role)
           .withColumn("owner_priority", lexical.owner_signal(reasons, F.col("score"), F.col("content"), path, terms))
           .withColumn("anchor_priority", F.when(exact, 0).when(lexical.names_path(path, terms), 1).otherwise(2))
           .withColumn("structure_score", lexical.structure_score(F.col("chunk_role"), path, F.col("content"), reasons, terms, target)))
    keys = ["anchor_priority"] if target == "all" else [F.desc("is_primary"), "role_priority", "owner_priority"]
    w = Window.partitionBy("query_id").orderBy(*keys, F.desc("structure_score"), F.desc("score"), "rank", "id")
    return out.withColumn("rank", F.row_number().over(w))


def place_related(results: DataFrame, limit: int) -> DataFrame:
    """`limit` rows a query of rows that carry is_primary, result_group and their order among their own kind in `pick`; the final order is in `rank`.

    Primary rows come first; related rows have a reserve of places, or all that primary rows leave free:
    the first row of each group in group order, then the rest.
    """
    q, kind = Window.partitionBy("query_id"), Window.partitionBy("query_id", "is_primary")
    order = F.lit(len(GROUPS))
    for i, g in enumerate(GROUPS[1:]):
        order = F.when(F.col("result_group") == g, i).otherwise(order)
    r = results.withColumn("primaries", F.count_if("is_primary").over(q).cast("int")).withColumn("others", F.count_if(~F.col("is_primary")).over(q).cast("int"))
    r = r.withColumn("shown", F.least("primaries", limit - related_reserve(F.lit(limit), F.col("primaries"), F.col("others"))))
    r = r.withColumn("in_group", F.row_number().over(Window.partitionBy("query_id", "is_primary", "result_group").orderBy("pick", "id")))
    turn = F.when(F.col("is_primary"), 0).when(F.col("in_group") == 1, order).otherwise(len(GROUPS))
    r = r.withColumn("side", F.row_number().over(kind.orderBy(turn, "pick", "id")))
    r = r.withColumn("rank", F.when(F.col("is_primary"), F.when(F.col("side") <= F.col("shown"), F.col("side"))).otherwise(F.col("shown") + F.col("side")))
    return r.filter(F.col("rank") <= limit).drop("primaries", "others", "shown", "in_group", "side", "pick")


def line_sets(rows: DataFrame) -> DataFrame:
    """(relative_path, id, ls, key, n) of rows with four meaningful lines or more; equal sets of n lines have one key."""
    return rows.select("relative_path", "id", T.meaningful_lines(F.col("content")).alias("ls")).filter(F.size("ls") >= 4).withColumn("key", F.xxhash64(F.array_sort("ls"))).withColumn("n", F.size("ls"))


def line_classes(rows: DataFrame) -> DataFrame:
    """(relative_path, id, class_id): the members of similar_files_lines alone."""
    lines = line_sets(rows).drop("ls")
    named = lines.groupBy("relative_path", "key", "n").agg(F.min("id").alias("class_id"))
    return lines.join(named, ["relative_path", "key", "n"]).select("relative_path", "id", "class_id")


def similar_files_lines(rows: DataFrame, least: float = 0.6, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Near duplicates by the sets of their meaningful lines, over whole tables: (members, pairs) of (relative_path, id, content).

    members: (relative_path, id, class_id): rows of one path with equal sets are one class, named by the
    smallest id. pairs: (relative_path, a, b, similarity) of classes of one path whose sets are alike to
    at least `least`, each once. Rows with fewer than four such lines are like nothing.

    Two sets of n and m lines need ceil(least / (1 + least) * (n + m)) lines in common. So only classes
    with as many lines that others hold too go on, candidates share one of the rarest of these (as many
    as make it certain), and only numbers of these lines are compared: no text moves after its lines are
    counted, and no line is too common to count. What moves is in proportion to the rows, then to the
    candidates, of which there are a few for each pair of the result. folder: a new folder for the
    numbered lines of these few classes; without one they are made anew for each of the four times they are read.
    """
    node = ["relative_path", "id", "key"]
    classes = line_sets(rows).groupBy("relative_path", "key", "n").agg(F.min("id").alias("id"), F.any_value("ls").alias("ls")).filter("id is not null")
    line = Window.partitionBy("relative_path", "line")
    shared = (classes.select(*node, "n", F.posexplode("ls").alias("pos", "line")).withColumn("held", F.count("*").over(line))
              .withColumn("first", F.min(F.struct("id", "key", "pos")).over(line)).filter("held > 1"))  # the first to hold a line names it
    name = F.concat_ws(":", F.col("first.id").cast("string"), F.col("first.key").cast("string"), F.col("first.pos").cast("string"))
    need = lambda n, m: F.ceil((n + m) * F.lit(least / (1 + least)) - 1e-9)
    fewest = need(F.col("n"), F.greatest(F.lit(4), F.ceil(F.col("n") * F.lit(least) - 1e-9)))
    sets = (shared.groupBy(*node, "n").agg(F.array_sort(F.collect_list(F.struct("held", name.alias("name")))).alias("rarest")).filter(F.size("rarest") >= fewest)
            .select("relative_path", F.struct("id", "key").alias("node"), "n", F.size("rarest").alias("s"), F.col("rarest.name").alias("names"), fewest.alias("fewest")))
    if folder:
        sets.write.parquet(folder)
        sets = rows.sparkSession.read.schema(sets.schema).parquet(folder)
    front = sets.select("relative_path", "node", "n", "s", F.explode(F.slice("names", F.lit(1), (F.col("s") - F.col("fewest") + 1).cast("int"))).alias("name"))
    side = lambda f, x, *more: f.select("relative_path", F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in more])
    fits = (F.col("a.id") < F.col("b.id")) & (F.least("s_a", "s_b") >= need(F.col("n_a"), F.col("n_b")))
    met = side(front, "a", "n", "s", "name").join(side(front, "b", "n", "s", "name").withColumnRenamed("name_b", "name_a"), ["relative_path", "name_a"]).filter(fits)
    found = met.select("relative_path", "a", "b").distinct()
    both = F.size(F.array_intersect("names_a", "names_b"))
    alike = (found.join(side(sets, "a", "n", "names"), ["relative_path", "a"]).join(side(sets, "b", "n", "names"), ["relative_path", "b"])
             .select("relative_path", F.col("a.id").alias("a"), F.col("b.id").alias("b"), (both / (F.col("n_a") + F.col("n_b") - both)).alias("similarity")))
    return line_classes(rows), alike.filter(F.col("similarity") >= least)
