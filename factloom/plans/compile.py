"""A whole rule set as one plan.

Each selection, of whatever rule, becomes one flag of a single scan of the types, which is
written as a narrow table and read by all that follows; so are the members that some rule's
subject holds. Each family of edges is read once, only the edges of subjects where all rules
have theirs on one side, joined twice with the flags, and a row comes out for every rule that the
edge breaks. So the number of scans depends on the families used, not on the number of rules.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import member_display
from ..functions.patterns import name_like, namespace_like
from ..operators.select import RuleFault, Scan, built_from, columns_of, first_error, guarded, member_condition
from ..schema import SITES, VIOLATIONS, Facts
from ..session import written
from ..spec import Constraint, MemberSelection, Rule

#: Rules of one plan; a larger set becomes several plans, each of which reads the facts again.
CHUNK = 96

EMPTY_TYPES = "the subject selects no type"
EMPTY_MEMBERS = "the subject selects no member"


@dataclass(frozen=True)
class EdgeVerb:
    """How an edge breaks a rule: the side its subject is on, whether operands are forbidden or the
    only ones allowed, and whether outside types are exempt."""

    family: str
    kind: str
    subject: str = "source"
    only: bool = False
    spare_external: bool = False
    warns: bool = False


EDGE_VERBS = {
    "must_not_reference": EdgeVerb("reference", "Reference", warns=True),
    "must_not_be_referenced_by": EdgeVerb("reference", "Reference", subject="target", warns=True),
    "must_only_reference": EdgeVerb("reference", "Reference", only=True, spare_external=True),
    "must_only_be_referenced_by": EdgeVerb("reference", "Reference", subject="target", only=True),
    "must_not_construct": EdgeVerb("construct", "Construction", warns=True),
    "must_not_inject": EdgeVerb("inject", "Injection"),
    "must_not_catch": EdgeVerb("catch", "Catch", warns=True),
    "must_not_expose": EdgeVerb("expose", "Expose", warns=True),
    "must_only_throw": EdgeVerb("throw", "Throw", only=True),
}


def type_demand(c: Constraint, facts: Facts) -> Column:
    """What a type must be; None where a Python predicate says it."""
    match c.verb:
        case "must_reside_in_namespace":
            return namespace_like(F.col("namespace"), c.value)
        case "must_have_suffix":
            return F.col("name").endswith(c.value)
        case "must_have_prefix":
            return F.col("name").startswith(c.value)
        case "must_have_name_matching":
            return name_like(F.col("name"), c.value)
        case "must_implement" | "must_derive_from" | "must_be_attributed_with" | "must_not_implement" | "must_not_derive_from" | "must_not_be_attributed_with":
            column = "all_interfaces" if "implement" in c.verb else "base_type_chain" if "derive" in c.verb else "attribute_constructions"
            found = reduce(lambda a, b: a | b, [F.coalesce(built_from(column, r), F.lit(False)) for r in c.value])
            return ~found if "_not_" in c.verb else found
        case "must_be_sealed" | "must_be_static" | "must_be_abstract":
            return F.col("is_" + c.verb.removeprefix("must_be_"))
        case "must_be_public" | "must_be_internal":
            return F.col("accessibility") == c.verb.removeprefix("must_be_").capitalize()
        case "must":
            return c.value(columns_of(facts.types))
    raise RuleFault(f"there is no demand {c.verb} on types")


def member_demand(c: Constraint, facts: Facts) -> Column:
    """What a member must be."""
    match c.verb:
        case "must_have_suffix":
            return F.col("name").endswith(c.value)
        case "must_have_prefix":
            return F.col("name").startswith(c.value)
        case "must_have_name_matching":
            return name_like(F.col("name"), c.value)
        case "must_be_public" | "must_be_internal" | "must_be_private":
            return F.col("accessibility") == c.verb.removeprefix("must_be_").capitalize()
        case "must_be_static" | "must_be_abstract" | "must_be_virtual":
            return F.col("is_" + c.verb.removeprefix("must_be_"))
        case "must_accept_parameter":
            if c.value.closed:
                raise RuleFault(f"`{c.value.full_name}` has type arguments; parameters are matched by definition")
            return F.exists("parameters", lambda p: p.type_full_name == F.lit(c.value.definition))
        case "must":
            return c.value(columns_of(facts.members))
    raise RuleFault(f"there is no demand {c.verb} on members")


@dataclass
class _Plan:
    """One rule, resolved to names of flags."""

    rule: Rule
    number: int
    subject: str | None = None
    operands: list[str] = field(default_factory=list)
    #: found while compiling: of the subject, or of the rest, which only counts if there is a subject
    fault: str | None = None
    late_fault: str | None = None
    demand: Column | None = None
    demand_column: str | None = None
    errors: list[str] = field(default_factory=list)
    late_errors: list[str] = field(default_factory=list)
    member: Column | None = None


@dataclass
class Compiled:
    """What evaluation gives: violations, and (rule_id) of rules that forbid what matches nothing."""

    violations: DataFrame
    idle: DataFrame

    @property
    def inert(self) -> DataFrame:
        """(rule_id): rules to be warned of, which are idle and not broken."""
        return self.idle.join(self.violations.select("rule_id").distinct(), "rule_id", "left_anti")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def evaluate(facts: Facts, rules: list[Rule], fused: bool = True) -> Compiled:
    """All violations of rules that have a constraint, and (rule_id) of rules whose operands are inert.

    fused=False compiles each rule on its own: the same rows at the cost of more scans.
    """
    own = [r for r in rules if r.constraint is not None]
    size = CHUNK if fused else 1
    parts = [_evaluate(facts, own[i : i + size]) for i in range(0, len(own), size)]
    spark = facts.types.sparkSession
    if not parts:
        return Compiled(spark.createDataFrame([], VIOLATIONS), spark.createDataFrame([], "rule_id string"))
    return Compiled(_union([p.violations for p in parts]), _union([p.idle for p in parts]))


def _row(kind: str | Column, **slots: Column) -> list[Column]:
    """A row of violations: rule number and the given slots, the others null."""
    names = ("source", "target", "subject", "member_symbol_id", "member_display", "sites", "detail", "id_source", "id_target", "id_subject")
    made = [slots.get(n, F.lit(None)).cast(SITES if n == "sites" else "string").alias(n) for n in names]
    return [F.col("rule"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), *made]


def _broken(conditions: list[tuple[int, Column]]) -> Column:
    """One row per broken rule; the row is lost where none is."""
    # filter() before explode() keeps a clean row from being copied at all
    return F.explode(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in conditions]), lambda x: x.isNotNull())).alias("rule")


def _evaluate(facts: Facts, rules: list[Rule]) -> Compiled:
    spark = facts.types.sparkSession
    scan = Scan(facts)
    plans = [_resolve(scan, facts, r, i) for i, r in enumerate(rules)]
    # Python predicates on members are columns of the members table
    members = facts.members
    for p in plans:
        c = p.rule.constraint
        if isinstance(c.subject, MemberSelection):
            for f in c.subject.filters:
                if f.kind == "where" and f.python:
                    members = members.withColumn(f"__{id(f)}", guarded(f.value, facts.members, "symbol_id")(F.lit(True)))
                    p.errors.append(f"__{id(f)}")
    demanded = {f"v{p.number}": F.col(p.subject) & ~F.coalesce(p.demand, F.lit(False)) for p in plans if p.demand is not None and p.subject and p.member is None and p.demand_column is None}
    python = [p for p in plans if p.demand_column and p.member is None]
    shown = ["full_name", "symbol_id", "is_external"] + ["declaration_sites"] * any(p.demand is not None and p.member is None for p in plans)
    flags = scan.table(facts.types.columns if python else shown, demanded)
    for p in python:
        flags = flags.withColumn(p.demand_column, guarded(p.rule.constraint.value, facts.types)(F.col(p.subject)))
        p.late_errors.append(p.demand_column)
    # read three times and more: the ends of the edges, the shapes, the state of the rules
    flags = written(flags.select(*shown, *scan.columns, *demanded, *[p.demand_column for p in python]), "flags")
    found: list[DataFrame] = []
    for family in dict.fromkeys(EDGE_VERBS[p.rule.constraint.verb].family for p in plans if p.rule.constraint.verb in EDGE_VERBS and p.subject and not p.late_fault):
        found.append(_edges(facts, flags, [p for p in plans if p.rule.constraint.verb in EDGE_VERBS and EDGE_VERBS[p.rule.constraint.verb].family == family and p.subject and not p.late_fault], family))
    uses = [p for p in plans if p.rule.constraint.verb == "must_not_use" and p.subject]
    if uses:
        found.append(_uses(facts, flags, uses))
    shapes = [p for p in plans if p.subject and p.member is None and p.demand is not None]
    if shapes:
        conditions = [(p.number, F.col(f"v{p.number}") if p.demand_column is None else F.col(p.subject) & ~F.coalesce(F.col(f"{p.demand_column}.ok"), F.lit(False))) for p in shapes]
        found.append(flags.select("full_name", "symbol_id", "declaration_sites", _broken(conditions)).select(*_row("Shape", subject=F.col("full_name"), sites=F.col("declaration_sites"), id_subject=F.col("symbol_id"))))
    shaped = [p for p in plans if p.subject and p.member is not None]
    joined = None
    if shaped:
        owners = flags.select(F.col("full_name").alias("__owner"), *dict.fromkeys(p.subject for p in shaped))
        joined = members.join(owners, F.col("declaring_type") == F.col("__owner"))
        for p in shaped:
            joined = joined.withColumn(f"m{p.number}", F.col(p.subject) & p.member)
            if p.demand_column:
                joined = joined.withColumn(p.demand_column, guarded(p.rule.constraint.value, facts.members, "symbol_id")(F.col(f"m{p.number}")))
                p.late_errors.append(p.demand_column)
        held = ["declaring_type", "symbol_id", "name", "kind", "declaration_sites", *[f"m{p.number}" for p in shaped]]
        tested = {f"x{p.number}": F.col(f"m{p.number}") & ~F.coalesce(F.col(f"{p.demand_column}.ok") if p.demand_column else p.demand, F.lit(False)) for p in shaped if p.demand is not None and not p.late_fault}
        failing = dict.fromkeys(e for p in shaped for e in p.errors + p.late_errors if e in joined.columns and e not in flags.columns)
        of_rules = _any([f"m{p.number}" for p in shaped])
        for e in failing:
            of_rules = of_rules | F.col(f"{e}.err").isNotNull()
        # only members of subjects, and those that a predicate failed on
        joined = written(joined.where(of_rules).select(*held, *failing, *[c.alias(n) for n, c in tested.items()]), "members")
        broken = [(int(n[1:]), F.col(n)) for n in tested]
        if broken:
            found.append(joined.select("declaring_type", "symbol_id", "name", F.col("kind").alias("__kind"), "declaration_sites", _broken(broken)).select(*_row("MemberShape", member_symbol_id=F.col("symbol_id"), member_display=member_display(F.col("declaring_type"), F.col("name"), F.col("__kind")), sites=F.col("declaration_sites"), id_subject=F.col("symbol_id"))))
    state = _state(flags, joined, plans, spark)
    failed = state.where("error is not null or not some").select("rule")
    rows = _union(found) if found else None
    if rows is not None and any(p.errors or p.late_errors for p in plans):
        rows = rows.join(F.broadcast(failed), "rule", "left_anti")  # a row per rule at most
    empty = state.where("error is null and not some").select(*_row("EmptySubject", detail=F.col("message")))
    broken = state.where("error is not null").select(*_row("RuleError", detail=F.col("error")))
    rows = _union([x for x in (rows, empty, broken) if x is not None])
    names = F.element_at(F.array(*[F.lit(r.id) for r in rules]), F.col("rule") + 1)
    violations = rows.select(names.alias("rule_id"), *[c for c in rows.columns if c != "rule"])
    # only verbs that forbid warn, and only of operands that are patterns
    idle = state.where("may_warn and some and not operand and error is null")
    return Compiled(violations, idle.select(names.alias("rule_id")))


def _resolve(scan: Scan, facts: Facts, rule: Rule, number: int) -> _Plan:
    c, p = rule.constraint, _Plan(rule, number)
    try:
        p.subject = scan.flag(c.types, "subject")
        p.errors += scan.errors[p.subject]
        if isinstance(c.subject, MemberSelection):
            p.member = member_condition(c.subject, facts)
            for f in c.subject.filters:
                if f.kind == "returning" and any(r.closed for r in f.value):
                    raise RuleFault("return types are matched by definition")
    except RuleFault as e:
        p.subject, p.fault = None, str(e)
        return p
    try:
        if c.verb in EDGE_VERBS:
            p.operands = [scan.flag(o, "target") for o in c.operands]
            p.late_errors += [e for o in p.operands for e in scan.errors[o]]
        elif c.verb == "must_not_use":
            for m in c.operands:
                if m.type.closed:
                    raise RuleFault(f"`{m.type.full_name}` has type arguments; members belong to `{m.type.definition}`")
        elif c.verb == "must" and c.python:
            p.demand, p.demand_column = F.lit(True), f"d{number}"
        else:
            p.demand = member_demand(c, facts) if p.member is not None else type_demand(c, facts)
    except RuleFault as e:
        p.late_fault = str(e)
    return p


def _any(flags: list[str], prefix: str = "") -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(prefix + f), F.lit(False)) for f in flags])


def _edges(facts: Facts, flags: DataFrame, plans: list[_Plan], family: str) -> DataFrame:
    def side(name: str) -> DataFrame:
        need = dict.fromkeys(f for p in plans for v in [EDGE_VERBS[p.rule.constraint.verb]] for f in ([p.subject] if v.subject == name else p.operands))
        return flags.select(F.col("full_name").alias(f"__{name}"), F.col("symbol_id").alias(f"__{name}_id"), F.col("is_external").alias(f"{name}_external"), *[F.col(f).alias(f"{name}_{f}") for f in need])

    conditions, asked = [], {"source": [], "target": []}
    for p in plans:
        v = EDGE_VERBS[p.rule.constraint.verb]
        other = "target" if v.subject == "source" else "source"
        mine, theirs = F.coalesce(F.col(f"{v.subject}_{p.subject}"), F.lit(False)), _any(p.operands, f"{other}_")
        broken = mine & ~theirs if v.only else mine & theirs
        if v.spare_external:
            broken = broken & ~F.coalesce(F.col(f"{other}_external"), F.lit(True))
        conditions.append((p.number, broken))
        asked[v.subject].append([p.subject])
        asked[other].append(None if v.only else p.operands)
    ends, among = {}, {}
    # where each rule asks for types of its own at an end, edges of others are left out before they are grouped
    for end, flags_of in asked.items():
        ends[end], among[end] = side(end), None
        if None not in flags_of:
            ends[end] = ends[end].where(_any(list(dict.fromkeys(f for own in flags_of for f in own)), f"{end}_"))
            among[end] = ends[end].select(f"__{end}")
    how = {end: "left" if among[end] is None else "inner" for end in ends}
    own = facts.edges_among(family, among["source"], among["target"])
    joined = own.join(ends["source"], F.col("source") == F.col("__source"), how["source"]).join(ends["target"], F.col("target") == F.col("__target"), how["target"])
    kind = EDGE_VERBS[plans[0].rule.constraint.verb].kind
    return joined.select("source", "target", "sites", "__source_id", "__target_id", _broken(conditions)).select(*_row(kind, source=F.col("source"), target=F.col("target"), sites=F.col("sites"), id_source=F.col("__source_id"), id_target=F.col("__target_id")))


def _uses(facts: Facts, flags: DataFrame, plans: list[_Plan]) -> DataFrame:
    users = flags.where(_any(list(dict.fromkeys(p.subject for p in plans)))).select(F.col("full_name").alias("__source"), F.col("symbol_id").alias("__source_id"), *dict.fromkeys(p.subject for p in plans))
    bans: dict[tuple[str, str], list[int]] = {}
    for p in plans:
        for m in () if p.late_fault else p.rule.constraint.operands:
            bans.setdefault((m.type.definition, m.name), []).append(p.number)
    # a row per banned member, joined by key: a spec may ban any number of them
    table = facts.types.sparkSession.createDataFrame([(t, n, sorted(set(r))) for (t, n), r in bans.items()], "__type string, __name string, __rules array<int>")
    same = (F.col("containing_type") == F.col("__type")) & (F.col("member_name") == F.col("__name"))
    own = facts.uses_among(users.select("__source"), table.select("__type", "__name")).join(table, same)
    joined = own.join(users, F.col("source") == F.col("__source"))
    held = F.array(*[F.when(F.col(p.subject), F.lit(p.number)) for p in plans])
    chosen = F.explode(F.filter(F.array_intersect(held, F.col("__rules")), lambda x: x.isNotNull())).alias("rule")
    display = member_display(F.col("containing_type"), F.col("member_name"), F.col("member_kind"))
    return joined.select("source", "containing_type", "member_name", "member_symbol_id", "member_kind", "sites", "__source_id", chosen).select(*_row("MemberUse", source=F.col("source"), member_symbol_id=F.col("member_symbol_id"), member_display=display, sites=F.col("sites"), id_source=F.col("__source_id"), id_target=F.col("member_symbol_id")))


def _state(flags: DataFrame, joined: DataFrame | None, plans: list[_Plan], spark) -> DataFrame:
    """One row per rule: whether its subject and operands select some type, the error, if any, and
    whether inert operands would be worth a warning."""
    wanted, of_members = {}, {}
    on_members = lambda p, e: e.startswith("__") or e == p.demand_column and p.member is not None
    for p in plans:
        if p.subject and p.member is None:
            wanted[f"some{p.number}"] = F.bool_or(F.col(p.subject))
        if p.subject and p.member is not None:
            of_members[f"some{p.number}"] = F.bool_or(F.col(f"m{p.number}"))
        if p.operands:
            wanted[f"operand{p.number}"] = F.bool_or(_any(p.operands))
        for e in p.errors + p.late_errors:
            (of_members if on_members(p, e) else wanted)[f"err{p.number}_{e}"] = first_error(flags, e, "symbol_id" if on_members(p, e) else "full_name")
    one = flags.agg(*[c.alias(n) for n, c in wanted.items()], F.lit(1).alias("__one")) if wanted else spark.range(1)
    if of_members:
        one = one.crossJoin(joined.agg(*[c.alias(n) for n, c in of_members.items()]))  # one row each
    rows = []
    for p in plans:
        c = p.rule.constraint
        text = lambda x: F.lit(x).cast("string")
        early = F.coalesce(text(p.fault), *[F.col(f"err{p.number}_{e}") for e in p.errors])
        some = F.coalesce(F.col(f"some{p.number}"), F.lit(False)) if p.subject else F.lit(False)
        late = F.when(some, F.coalesce(text(p.late_fault), *[F.col(f"err{p.number}_{e}") for e in p.late_errors]))
        may = c.verb in EDGE_VERBS and EDGE_VERBS[c.verb].warns and any(o.is_pattern() for o in c.operands)
        operand = F.coalesce(F.col(f"operand{p.number}"), F.lit(False)) if p.operands else F.lit(False)
        rows.append(F.struct(F.lit(p.number).alias("rule"), some.alias("some"), operand.alias("operand"), F.coalesce(early, late).alias("error"), F.lit(may).alias("may_warn"), F.lit(EMPTY_MEMBERS if isinstance(c.subject, MemberSelection) else EMPTY_TYPES).alias("message")))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
