"""Reports over game assets: abilities, effects and tags, behaviour trees, animation, and who uses which class."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cordage.operators.reports import variants
from cordage.sources.assets import likely_tag, stem

# Root classes by kind.
KIND_ROOTS = [("UGameplayAbility", "ability"), ("UGameplayEffect", "effect"), ("UAttributeSet", "attribute_set"), ("UAbilitySystemComponent", "component")]
# Words of state names, labels of graphs, beginnings of descriptions, hints in notifies' names, and type numbers of animators.
STATE_WORDS = [
    "Idle", "Walk", "Run", "Jump", "Land", "Fall", "Attack", "Death", "Hit", "Dodge", "Cast", "Aim", "Crouch", "Sprint", "Slide", "Roll", "Jog", "Fly", "Swim", "Climb", "Grab", "Throw",
    "Block", "Parry", "Stagger", "Knockback", "Stunned", "Dead", "Spawn", "Locomotion", "Fire", "Shoot", "Kick", "Punch", "Slash", "Dash", "Evade", "Guard", "Stand", "Sit", "Attacking",
    "Moving", "Falling", "Landing",
]
GRAPH_LABELS = ["Anim Graph", "Event Graph", "Macro Graph", "Uber Graph", "Option 0", "Option 1", "Option 2", "Option 3", "Entry", "Result", "Output"]
DESCRIPTIONS = [
    "The ", "A ", "An ", "This ", "Set ", "Get ", "If ", "When ", "Whether ", "Executed ", "Always ", "Skip ", "Allow ", "Reset ", "Transfer ", "Create ", "Can ", "Input ", "Output ", "alpha ",
    "Reinitialize", "Scale ", "Start from", "LOD ", "Play Rate", "Blend Space", "Slot Name", "Blend Weight", "Blend Time", "Blend Type", "Blend Mode", "Blend Pose", "Blend Poses", "Blend Masks",
    "Blend Weights", "Blend Profile", "Blend Settings", "Blend Depth", "Loop Animation", "Loop", "Start Position", "Play Rate Basis", "Max Transitions", "Max Iterations", "Reach Precision",
    "Soft Alpha", "Soft Percent", "Alpha Scale", "Alpha Curve", "Alpha Input", "Group Name", "Group Role", "Layer Setup", "Local Pose", "Component Pose", "Base Pose", "Internal Time",
    "Ignore for", "Foot IK", "Legs Definition", "Upper Body Layer", "Curve Blend", "Mesh Space", "Root Space", "Transition Type", "Child Upate", "Custom Blend", "Active Value", "Is Valid",
    "Is Not Valid", "Is Falling", "Is Attacking", "Is Accelerating", "Is in Air", "Ground Speed", "Should Move", "Movement Component", "Character Movement", "Orient Rotation", "Rotation Last",
    "Yaw Delta", "Asset User", "Event Queue", "Control Rig", "Lean intensity", "Setting Yaw",
]
NOTIFY_HINTS = ["Ability", "GAS", "GameplayAbility", "GameplayCue", "Effect", "Attack", "Fire", "Launch", "Activate", "ApplyEffect", "TriggerAbility", "Event"]
PARAMETER_TYPES = {"0": "Float", "1": "Int", "2": "Bool", "3": "Trigger", "9": "Bool"}
BLEND_TYPES = {"0": "1D", "1": "2D Simple", "2": "2D Freeform", "3": "Direct"}
UE_CATEGORIES = [("A", "actor"), ("U", "object"), ("F", "struct"), ("E", "enum"), ("I", "interface")]


def prefix_category(name: Column) -> Column:
    """actor, object, struct, enum or interface by the first letter, if a capital follows it; else other."""
    out = F.lit("other")
    for letter, kind in reversed(UE_CATEGORIES):
        out = F.when(name.rlike(f"^{letter}[A-Z]"), kind).otherwise(out)
    return out


def engine_classification(types: DataFrame, engine: DataFrame) -> DataFrame:
    """name, class: engine_base if the engine has it (engine: name), engine_derived if one of its bases is the engine's, else project."""
    own = types.join(engine.select("name", F.lit(True).alias("_own")).distinct(), "name", "left")
    bases = types.select("name", F.explode("base_types").alias("base")).join(engine.select(F.col("name").alias("base")), "base", "left_semi").select("name", F.lit(True).alias("_derived")).distinct()
    return own.join(bases, "name", "left").select("name", F.when(F.col("_own"), "engine_base").when(F.col("_derived"), "engine_derived").otherwise("project").alias("class"))


def entry_points(methods: DataFrame, lifecycle: list[str]) -> DataFrame:
    """cls, name, pos of the lifecycle methods that there are, in the given order."""
    order = methods.sparkSession.createDataFrame(list(enumerate(lifecycle)), "pos int, name string")
    return methods.select("cls", "name").distinct().join(F.broadcast(order), "name").orderBy("cls", "pos")


def tag_distribution(tags: DataFrame) -> DataFrame:
    """root, tags: distinct likely tags (column tag) by their first part."""
    rows = tags.filter(likely_tag(F.col("tag"))).select("tag").distinct()
    return rows.groupBy(F.split("tag", r"\.")[0].alias("root")).agg(F.count("*").alias("tags"))


def role_counts(assets: DataFrame, role: Column) -> DataFrame:
    return assets.groupBy(role.alias("role")).agg(F.count("*").alias("assets"))


def scan_coverage(assets: DataFrame) -> DataFrame:
    """scanned, parsed, stubs, pct of binary assets (is_stub)."""
    from cordage.operators.reports import coverage

    rows = assets.agg(F.count("*").alias("scanned"), F.count_if(~F.col("is_stub")).alias("parsed"), F.count_if("is_stub").alias("stubs"))
    return rows.withColumn("pct", coverage(F.col("parsed"), F.col("scanned")))


def fallback_catalogue(assets: DataFrame, role: Column) -> DataFrame:
    """role, assets, mostly_stubs: a catalogue by name alone, and whether over half of the assets are stubs."""
    most = assets.agg((F.count_if("is_stub") > F.floor(F.count("*") / 2)).alias("mostly_stubs"))
    return assets.groupBy(role.alias("role")).agg(F.count("*").alias("assets")).join(F.broadcast(most))


def class_assets(classes: DataFrame, assets: DataFrame) -> DataFrame:
    """cls, asset, name: assets (asset, name, parent) whose parent class is a variant of the class's name (classes: cls), one per name."""
    tried = classes.select("cls", F.explode(variants(F.col("cls"))).alias("parent"))
    nth = F.row_number().over(Window.partitionBy("cls", "name").orderBy("asset"))
    return tried.join(assets.select("asset", "name", "parent"), "parent").withColumn("n", nth).filter("n = 1").select("cls", "asset", "name")


def family_assets(cls: DataFrame, closure: DataFrame, assets: DataFrame) -> DataFrame:
    """start, cls, asset, name, direct: assets of a class (column start) and of all its descendants (closure: start, name), its own first."""
    family = cls.select("start", F.col("start").alias("cls"), F.lit(True).alias("direct")).unionByName(closure.join(cls, "start", "left_semi").select("start", F.col("name").alias("cls"), F.lit(False).alias("direct")))
    rows = family.join(class_assets(family.select("cls").distinct(), assets), "cls")
    nth = F.row_number().over(Window.partitionBy("start", "name").orderBy(F.desc("direct"), "cls", "asset"))
    return rows.withColumn("n", nth).filter("n = 1").drop("n").orderBy("start", F.desc("direct"), "cls", "name")


def controller_usage(controllers: DataFrame, trees: DataFrame) -> DataFrame:
    """name, controllers: behaviour and state trees (name) that controllers (name, text) mention."""
    said = controllers.select(F.col("name").alias("controller"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b((?:BT|ST)_\w+)"), F.lit(1)))).alias("name"))
    return trees.join(said, "name").groupBy("name").agg(F.array_sort(F.collect_set("controller")).alias("controllers"))


def ability_edges(classes: DataFrame, effects: DataFrame, attributes: DataFrame, tags: DataFrame, most: int = 20) -> DataFrame:
    """src, dst, relation: what abilities apply, use and carry. ``most`` per class and relation, by name: the limit is the feature.

    classes (name, body): abilities and their text; effects, attributes (name); tags (name, tag).
    """
    words = classes.select(F.col("name").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"\b([A-Z]\w+)\b"), F.lit(1)))).alias("dst"))
    named = lambda what, relation: words.join(what.select(F.col("name").alias("dst")).distinct(), "dst").select("src", "dst", F.lit(relation).alias("relation"))
    rows = named(effects, "applies").unionByName(named(attributes, "uses_attr")).unionByName(tags.select(F.col("name").alias("src"), F.col("tag").alias("dst"), F.lit("uses_tag").alias("relation")))
    nth = F.row_number().over(Window.partitionBy("src", "relation").orderBy("dst"))
    return rows.dropDuplicates(["src", "dst"]).withColumn("n", nth).filter(F.col("n") <= most).drop("n")


def reference_summary(usages: DataFrame) -> DataFrame:
    """name, prefabs, scenes, total per class from usages (name, asset)."""
    low = F.lower("asset")
    return usages.groupBy("name").agg(F.count_if(low.endswith(".prefab")).alias("prefabs"), F.count_if(low.endswith(".unity") | low.endswith(".umap")).alias("scenes"), F.count("*").alias("total"))


def length_prefixed(text: Column, least: int = 3, most: int = 64) -> Column:
    """Printable strings of a binary asset (bytes as Latin-1) that end with a zero and stand after their own length in 4 bytes."""
    found = F.regexp_extract_all(text, F.lit(rf"(?s)([\x01-\x{most:02x}]\x00\x00\x00[\x20-\x7e]{{{least},{most}}}\x00)"), F.lit(1))
    right = F.filter(found, lambda s: F.ascii(F.substring(s, 1, 1)) == F.length(s) - 4)
    return F.array_distinct(F.transform(right, lambda s: F.substring(s, F.lit(5), F.length(s) - 5)))


def likely_state(name: Column) -> Column:
    """A state's name: 30 characters at most, no graph label, no beginning of a description; several words of which one is a known word or capitalised; or one word with a known one in it."""
    words = F.split(name, r"[ /\-]+")
    known = F.array(*[F.lit(w) for w in STATE_WORDS])
    several = name.rlike(r"^[A-Za-z0-9][A-Za-z0-9 /\-]+$") & (name != F.lower(name)) & F.exists(words, lambda w: F.array_contains(known, w) | (w.rlike("^[A-Z]") & (F.length(w) >= 3) & (F.length(w) <= 15)))
    parts = F.regexp_extract_all(name, F.lit(r"([A-Z][a-z]+)"), F.lit(1))
    single = name.isin(*STATE_WORDS) | (name.rlike(r"^[A-Z][a-z]+(?:[A-Z][a-z]+)*$") & (F.length(name) <= 20) & F.arrays_overlap(parts, known))
    return ~name.isin(*GRAPH_LABELS) & ~name.rlike(f"^({'|'.join(DESCRIPTIONS)})") & (F.length(name) <= 30) & F.when(F.contains(name, F.lit(" ")), several).otherwise(single)


def ability_notify(name: Column) -> Column:
    """Whether a notify's name hints at abilities, letters in either case."""
    return F.lower(name).rlike("|".join(h.lower() for h in NOTIFY_HINTS))


def named_by(number: Column, names: dict[str, str]) -> Column:
    """The name of a type's number (``PARAMETER_TYPES``, ``BLEND_TYPES``); a number without one stays."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), number), number)


def tag_matches(tag: Column, category: str | None = None, keyword: str | None = None) -> Column:
    """The tag is the category or below it, and holds the keyword; letters in either case."""
    low = F.lower(tag)
    right = F.lit(True) if not category else low.startswith(category.lower() + ".") | (low == category.lower())
    return right & low.contains(keyword.lower()) if keyword else right


def abilities_matching(abilities: DataFrame, category: str | None = None, keyword: str | None = None) -> DataFrame:
    """Of abilities (name, tags) those whose name holds the keyword or of whose tags one matches; all without category and keyword. A null name or
    null tags match nothing."""
    if not (category or keyword):
        return abilities
    by_tag = F.coalesce(F.exists("tags", lambda t: F.coalesce(tag_matches(t, category, keyword), F.lit(False))), F.lit(False))
    by_name = F.coalesce(F.lower("name").contains(keyword.lower()), F.lit(False)) if keyword else F.lit(False)
    return abilities.filter(by_name | by_tag)


def assets_matching(assets: DataFrame, keyword: str | None = None) -> DataFrame:
    """Of assets (name, classes, tags) those that hold the keyword in the name, a class they refer to, or a tag; all without one."""
    if not keyword:
        return assets
    held = lambda c: F.coalesce(F.exists(c, lambda x: F.coalesce(F.lower(x).contains(keyword.lower()), F.lit(False))), F.lit(False))
    return assets.filter(F.coalesce(F.lower("name").contains(keyword.lower()), F.lit(False)) | held("classes") | held("tags"))


def animation_assets(assets: DataFrame) -> DataFrame:
    """asset, name, kind (blueprint, montage), states: told by the first 2048 bytes, else by the name; of one name and kind the first asset."""
    head = F.substring("text", 1, 2048)
    blueprint = head.contains("AnimBlueprint") & head.rlike("StateMachine|AnimNode_Slot")
    montage = head.contains("AnimMontage") & head.rlike("CompositeSection|SectionName")
    by_name = F.when(F.col("name").rlike("^(ABP_|AnimBP)"), "blueprint").when(F.col("name").rlike("^AM_|_Montage$"), "montage")
    kind = F.when(blueprint, "blueprint").when(montage, "montage").otherwise(by_name)
    rows = assets.filter("NOT is_stub").withColumn("kind", kind).filter("kind IS NOT NULL")
    nth = F.row_number().over(Window.partitionBy("kind", "name").orderBy("path"))
    rows = rows.withColumn("n", nth).filter("n = 1")
    return rows.select(F.col("path").alias("asset"), "name", "kind", F.filter(length_prefixed(F.col("text")), likely_state).alias("states"))


def named(df: DataFrame, wanted: str) -> DataFrame:
    return df.filter(F.lower("name").contains(wanted.lower()))


def used_only(index: DataFrame) -> DataFrame:
    return index.filter(F.size("usages") > 0)


def test_files(paths: DataFrame) -> DataFrame:
    from cordage.sources.assets import is_test_file

    return paths.filter(is_test_file(F.col("path"))).select("path", stem(F.col("path")).alias("stem"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
