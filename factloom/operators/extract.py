"""Facts derived from rawer tables: type expressions taken apart, registrations recognised, exposure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import drop, written


def decomposed(expression: Column) -> Column:
    """All type names that a type expression is made of, each once: a generic type by its name and
    number of arguments (`IMap<A, B>` gives `IMap<2>`, A and B), an array by its element.

    The names are the runs between the signs < > , [ ]; a run that a < follows is generic, and the
    number of its arguments is one more than the commas at its own depth.
    """
    bare = F.regexp_replace(expression, r"\[,*\]|\?|\s", "")
    # the innermost argument lists are replaced by their length, again and again
    names = F.array().cast("array<string>")
    inner = r"([A-Za-z_][\w.]*)<([^<>]*)>"

    def step(acc: Column, _: Column) -> Column:
        found = F.regexp_extract_all(acc.text, F.lit(inner), F.lit(0))
        parts = F.flatten(F.transform(found, lambda x: F.concat(F.filter(F.split(F.regexp_extract(x, inner, 2), ","), lambda y: ~y.startswith("!") & (y != "")), F.array(F.concat(F.regexp_extract(x, inner, 1), F.lit("<"), F.size(F.split(F.regexp_extract(x, inner, 2), ",")).cast("string"), F.lit(">"))))))
        return F.struct(F.regexp_replace(acc.text, inner, "!").alias("text"), F.concat(acc.names, parts).alias("names"))

    depth = F.greatest(F.length(bare) - F.length(F.regexp_replace(bare, "<", "")), F.lit(1))
    out = F.aggregate(F.sequence(F.lit(1), depth), F.struct(bare.alias("text"), names.alias("names")), step, lambda acc: F.concat(acc.names, F.when(acc.text.startswith("!") | (acc.text == ""), names).otherwise(F.array(acc.text))))
    return F.array_distinct(out)


def normal_shape(types: DataFrame) -> DataFrame:
    """Types with the flags that a declaration means: what is static is neither sealed nor abstract."""
    return types.withColumn("is_sealed", F.col("is_sealed") & ~F.col("is_static")).withColumn("is_abstract", F.col("is_abstract") & ~F.col("is_static"))


def inventoried(members: DataFrame) -> DataFrame:
    """Raw members (with is_implicit, method_kind, is_indexer, explicit_interface) that count as declared."""
    ordinary = (F.col("kind") != "Method") | (F.col("method_kind") == "Ordinary")
    return members.where(~F.col("is_implicit") & ordinary & ~F.col("is_indexer") & ~F.col("explicit_interface")).drop("is_implicit", "method_kind", "is_indexer", "explicit_interface")


def injection_edges(constructors: DataFrame) -> DataFrame:
    """Edges from constructor parameters (declaring_type, parameter_type, file, line)."""
    own = constructors.select(F.col("declaring_type").alias("source"), F.explode(decomposed(F.col("parameter_type"))).alias("target"), F.struct("file", "line").alias("site"))
    return own.where("source <> target").groupBy("source", "target").agg(F.array_sort(F.collect_set("site")).alias("sites")).select(F.lit("inject").alias("family"), "source", "target", "sites")


def exposure_edges(members: DataFrame, types: DataFrame) -> DataFrame:
    """Edges to the types in public signatures: of public members of types that are public (types
    has is_visible for the whole chain of containing types, or accessibility)."""
    visible = F.col("is_visible") if "is_visible" in types.columns else F.col("accessibility") == "Public"
    shown = types.where(visible & ~F.col("is_external")).select("full_name")
    own = members.where("accessibility = 'Public'").join(shown, F.col("declaring_type") == F.col("full_name"), "left_semi")
    parts = F.array_compact(F.concat(F.array("return_type", "member_type"), F.transform("parameters", lambda p: p.type_full_name)))
    each = own.select(F.col("declaring_type").alias("source"), F.explode(F.array_distinct(F.flatten(F.transform(parts, decomposed)))).alias("target"), "declaration_sites")
    return each.where("source <> target").groupBy("source", "target").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("declaration_sites")))).alias("sites")).select(F.lit("expose").alias("family"), "source", "target", "sites")


def recognised_registrations(calls: DataFrame) -> DataFrame:
    """Registrations from calls (method, type_args, n_params, typeof_args, n_type_params, lifetime_arg, file, line).

    Add and TryAdd with a lifetime's name take service and implementation, or one type that is its
    own implementation if nothing else is passed; hosted services, database contexts and clients
    have their own rules. A lifetime that isn't written out (lifetime_arg "?") registers nothing.
    """
    m, args, spoken = F.col("method"), F.col("type_args"), F.col("typeof_args")
    family = F.regexp_extract(m, r"\A(?:Try)?Add(Singleton|Scoped|Transient)\z", 1)
    row = lambda life, s, i: F.struct(life.alias("lifetime"), s.alias("service"), i.alias("implementation"))
    none = F.lit(None).cast("string")
    given = F.col("lifetime_arg")
    context = F.when(given.isNull(), F.lit("Scoped")).when(given != "?", given)
    made = (
        F.when((family != "") & (F.size(args) == 2), row(family, args[0], args[1]))
        .when((family != "") & (F.size(args) == 1), row(family, args[0], F.when(F.col("n_params") == 0, args[0]).otherwise(none)))
        .when((family != "") & (F.size(spoken) >= 1) & (F.col("n_type_params") >= 2), row(family, spoken[0], F.get(spoken, F.lit(1))))
        .when((family != "") & (F.size(spoken) >= 1), row(family, spoken[0], F.when(F.col("n_params") == 1, spoken[0]).otherwise(none)))
        .when((m == "AddHostedService") & (F.size(args) == 1), row(F.lit("Singleton"), F.lit("Microsoft.Extensions.Hosting.IHostedService"), args[0]))
        .when(m.isin("AddDbContext", "AddDbContextPool") & F.size(args).between(1, 2) & context.isNotNull(), row(context, args[0], F.coalesce(F.get(args, F.lit(1)), args[0])))
        .when((m == "AddHttpClient") & F.size(args).between(1, 2), row(F.lit("Transient"), args[0], F.coalesce(F.get(args, F.lit(1)), args[0])))
    )
    own = calls.select(made.alias("r"), F.struct("file", "line").alias("site")).where("r is not null")
    return own.groupBy("r.lifetime", "r.service", "r.implementation").agg(F.array_sort(F.collect_set("site")).alias("sites"))


def substituted(base: Column, parameters: Column, arguments: Column) -> Column:
    """A constructed name with the type parameters in it replaced by arguments, all at once: a name
    counts where no letter, digit, underscore or dot stands beside it."""
    # first to marks that no name holds, then to the arguments, so that none is replaced twice
    marked = F.aggregate(F.sequence(F.lit(1), F.size(parameters)), base, lambda acc, i: F.regexp_replace(acc, F.concat(F.lit(r"(?<![\w.])"), F.element_at(parameters, i), F.lit(r"(?![\w.])")), F.concat(F.lit("\u0001"), i.cast("string"), F.lit("\u0002"))))
    filled = F.aggregate(F.sequence(F.lit(1), F.size(parameters)), marked, lambda acc, i: F.replace(acc, F.concat(F.lit("\u0001"), i.cast("string"), F.lit("\u0002")), F.element_at(arguments, i)))
    return F.when(F.size(parameters) == F.size(arguments), F.when(F.size(parameters) > 0, filled).otherwise(base)).otherwise(base)


def arguments_of(name: Column) -> Column:
    """The type arguments of a constructed name, `IMap<A, IList<B>>` giving A and IList<B>; none of a bare one."""
    inner = F.regexp_extract(name, r"<(.*)>\z", 1)
    # a comma parts arguments where as many lists are closed before it as opened
    pieces = F.split(inner, ",")
    depth = lambda x: F.length(F.regexp_replace(x, "[^<]", "")) - F.length(F.regexp_replace(x, "[^>]", ""))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, piece: Column) -> Column:
        text = F.when(acc.open == "", piece).otherwise(F.concat(acc.open, F.lit(","), piece))
        return F.struct(F.when(depth(text) == 0, F.concat(acc.done, F.array(F.trim(text)))).otherwise(acc.done).alias("done"), F.when(depth(text) == 0, "").otherwise(text).alias("open"))

    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.aggregate(pieces, start, step, lambda acc: acc.done))


def derived_hierarchy(direct: DataFrame) -> DataFrame:
    """(full_name, base, depth): all bases of each type from direct ones (full_name, base), nearest
    first, however long the chain. A base of a generic type, named by its definition `Box<T>`, has
    the arguments put in with which a type derives from it: of `Ints` below `Box<Int>` below
    `List<T>` also `List<Int>`."""
    own = direct.select("full_name", "base").distinct()
    bare = lambda c: F.concat(F.regexp_extract(c, r"\A([^<]*)", 1), F.lit("`"), F.size(arguments_of(c)).cast("string"))
    keyed = written(own.select(bare(F.col("full_name")).alias("key"), arguments_of(F.col("full_name")).alias("parameters"), F.col("base").alias("next")), "direct")
    found = written(own.withColumn("depth", F.lit(1)), "bases")
    frontier, depth = found, 1
    while True:
        depth += 1
        step = frontier.select("full_name", bare(F.col("base")).alias("key"), arguments_of(F.col("base")).alias("arguments")).join(keyed, "key")
        step = step.select("full_name", substituted(F.col("next"), F.col("parameters"), F.col("arguments")).alias("base")).distinct()
        step = step.join(found, ["full_name", "base"], "left_anti").where("full_name <> base").withColumn("depth", F.lit(depth))
        before, frontier = frontier, written(step, "bases")
        if before is not found:
            drop(before)
        if frontier.isEmpty():
            drop(keyed)
            return found
        before, found = found, written(found.unionByName(frontier), "bases")
        drop(before)
