"""The masking plan of a table: all column rules in one pass, in order, computed columns last.

Rules that look at one row only become expressions of a single projection. A rule that reads a column masked
before it starts a new projection. Shuffles, unique values and location records add their joins.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.functions import redact
from veilspark.functions.draw import Draws, key_text, value_key
from veilspark.functions.generators import RowView, recipe
from veilspark.operators.binary import mask_blob
from veilspark.operators.geometry import geometry_random, geometry_shuffle
from veilspark.operators.location import COORDINATES, location_by_country, location_record
from veilspark.operators.mapping import lookup, mapped_key
from veilspark.operators.numbering import bucket_count
from veilspark.operators.shuffle import shuffle_column
from veilspark.operators.unique import mask_unique
from veilspark.plans.rules import ColumnRule, RuleError, Settings, TableRule
from veilspark.sources.scratch import materialise, sized_for_join

# Value mappings that a rule carries in the plan; more are a table that is joined.
LITERAL_MAPPINGS = 1000
# Whole numbers that a mapped key may have unless the rule says so.
KEY_NUMBERS = {"tinyint": 1 << 7, "smallint": 1 << 15, "int": 1 << 31}
_UNCHANGED = {"NoMasking", "Unmask"}
_NESTED = (T.StructType, T.ArrayType)
_SHUFFLES = {"Shuffle", "ShufflePolygon"}
_NO_GENERATOR = {"None", "NULL", "Location", "Error"}
_BEFORE_LOCATION = {"File", "math", "MaskingOut", "Scramble", "exception", "Shufflegeometry", "Blob", "Ignore"}

# Rule types a fixed value may be given for, and the type it is read as: fixed values.
_TEXT_VALUE = set(
    "FirstName LastName Rant Lorem StringFormat Company Vehicle FullName CompanyPersonName PostalCode RandomUsername "
    "RandomYear RandomSeason PickRandom Shuffle FullAddress State SecondaryAddress City Date Bogus StringConcat "
    "PhoneNumber None TimeSpan".split()
)
_TYPED_VALUE = {"DateOfBirth": "timestamp_ntz", "RandomInt": "int", "RandomDec": "decimal(18,6)", "math": "decimal(18,6)"}


def use_value(rule: ColumnRule) -> tuple[Column, str]:
    """The constant of a rule and its type; the text NULL means null."""
    kind = "string" if rule.type in _TEXT_VALUE else _TYPED_VALUE.get(rule.type)
    if kind is None:
        raise RuleError(f"{rule.name}: a fixed value is not possible for rule type {rule.type}")
    if rule.use_value.upper() == "NULL":
        return F.lit(None).cast(kind), kind
    return F.lit(rule.use_value).cast(kind), kind


class _StagedDraws(Draws):
    """Draws computed once in an earlier projection; the second draw of a collision stays lazy."""

    def __init__(self, draws: Draws, stage: dict[str, Column], tag: str):
        self._draws, self._stage, self._tag = draws, stage, tag

    def digest(self, k=0):
        return self._draws.digest(k)

    def part(self, k, size, render):
        name = f"__p_{self._tag}_{k}_{size}"
        self._stage[name] = self._draws.part(k, size, render)
        return F.col(name)

    def __call__(self, k=0):
        if k == "s":
            return self._draws(k)
        name = f"__d_{self._tag}_{k}"
        self._stage[name] = self._draws(k)
        return F.col(name)


def _comparison(old: Column, old_type: T.DataType, new_kind: str):
    """How to tell that a new value equals the original: as numbers, as times, else as text."""
    numeric = isinstance(old_type, T.NumericType)
    new_numeric = new_kind.startswith(("int", "bigint", "decimal", "double"))
    if (numeric and new_numeric) or (old_type.simpleString() == new_kind):
        return lambda value: value.eqNullSafe(old)
    return lambda value: value.cast("string").eqNullSafe(old.cast("string"))


class TableMask:
    """Builds the masked DataFrame of one table."""

    def __init__(self, df: DataFrame, rule: TableRule, settings: Settings, keep_types: bool = True, failures: dict[str, str] | None = None):
        self.failures = failures
        self.source, self.df, self.rule, self.settings, self.keep_types = df, df, rule, settings, keep_types
        self.types = {f.name: f.dataType for f in df.schema.fields}
        self.stage: dict[str, Column] = {}
        self.held: dict[str, Column] = {}
        self.pending: dict[str, Column] = {}
        # Columns that joins have added and the next projection leaves out.
        self.extra: list[str] = []

    # Projections ----------------------------------------------------------------------------------

    def flush(self) -> None:
        """Close the current projection: draws first, first values over them, masked values over those.

        Each layer reads the one below more than once, so the optimizer keeps them apart: nothing is computed
        twice, and the generated code stays in methods small enough to be compiled.
        """
        if not self.pending:
            return
        names = [c for c in self.df.columns if c not in self.extra]
        for layer in (self.stage, self.held):
            if layer:
                self.df = self.df.select("*", *[c.alias(n) for n, c in layer.items()])
        kept = [self.pending[n].alias(n) if n in self.pending else F.col(n) for n in names]
        added = [c.alias(n) for n, c in self.pending.items() if n not in names]
        self.df = self.df.select(*kept, *added)
        self.stage, self.held, self.pending, self.extra = {}, {}, {}, []

    def reads(self, *names: str | None) -> None:
        """A rule is about to read these columns: they must hold their masked values."""
        if any(n in self.pending for n in names if n):
            self.flush()

    def put(self, name: str, value: Column, kind: str) -> None:
        """Set the masked value of a column, in the type of the column where types are kept.

        A value that does not fit the type must not end a long job, and must not leave the original: it becomes null, which the
        exception log counts.
        """
        target = self.types.get(name)
        if self.keep_types and target is not None and not isinstance(target, _NESTED) and target.simpleString() != kind:
            value = value.try_cast(target)
        self.pending[name] = value

    def sized(self) -> Settings:
        """Settings with the bucket count of this table; the rows are counted once, in the source."""
        if self.settings.buckets is None:
            self.settings = replace(self.settings, buckets=bucket_count(self.source.count()))
        return self.settings

    # Draws ----------------------------------------------------------------------------------------

    def scope(self, rule: ColumnRule) -> str:
        return rule.name if rule.global_mapping else f"{self.rule.name}.{rule.name}"

    def draws(self, rule: ColumnRule) -> Draws:
        key = key_text(*[F.col(k) for k in self.rule.key])
        if rule.global_mapping or rule.local_mapping:
            value = value_key(F.col(rule.name), self.types[rule.name].simpleString())
            # Nulls have no mapping: where they are replaced at all, each row draws for itself.
            key = value if rule.retain_null else F.when(F.col(rule.name).isNull(), F.concat(F.lit("#"), key)).otherwise(value)
        return Draws(self.settings.seed, self.scope(rule), key)

    def staged(self, rule: ColumnRule) -> Draws:
        return _StagedDraws(self.draws(rule), self.stage, f"{len(self.pending)}_{rule.name}")

    def hold(self, rule: ColumnRule, value: Column) -> Column:
        """Compute a value that is read more than once in a projection of its own."""
        name = f"__v_{len(self.pending)}_{rule.name}"
        self.held[name] = value
        return F.col(name)

    # One rule -------------------------------------------------------------------------------------

    def retained(self, rule: ColumnRule, new: Column, kind: str | None = None) -> Column:
        """Null stays null and blank stays blank where the rule says so."""
        old, old_type = F.col(rule.name), self.types[rule.name]
        kind = kind or old_type.simpleString()
        value = new
        if rule.retain_empty and isinstance(old_type, T.StringType):
            value = F.when(old.isNotNull() & redact.is_blank(old), old.cast(kind)).otherwise(value)
        if rule.retain_null:
            value = F.when(old.isNotNull(), value)
        return value

    def generated(self, rule: ColumnRule) -> tuple[Column, str]:
        self.reads(rule.gender_column)
        made = recipe(rule, self.settings)
        old, old_type = F.col(rule.name), self.types[rule.name]
        gender = F.col(rule.gender_column) if rule.gender_column else None
        row = RowView(self.staged(rule), old, gender)
        value = made.value(row, _comparison(old, old_type, made.kind), lambda first: self.hold(rule, first))
        if rule.local_mapping and (isinstance(rule.value_mappings, DataFrame) or rule.value_mappings):
            value = F.coalesce(self.supplied(rule).try_cast(made.kind), value)
        return value, made.kind

    def supplied(self, rule: ColumnRule) -> Column:
        """The value that a rule's own mappings give. A few are part of the plan, more are a table that is joined: broadcast if its size allows
        it, else shuffled, with hot values spread."""
        old, given = F.col(rule.name).cast("string"), rule.value_mappings
        if not isinstance(given, DataFrame) and len(given) <= LITERAL_MAPPINGS:
            return F.try_element_at(F.create_map(*[F.lit(x) for pair in given.items() for x in pair]), old)
        if not isinstance(given, DataFrame):
            given = self.df.sparkSession.createDataFrame(list(given.items()), "old string, new string")
        before, after = given.columns
        key, new = f"__k_{rule.name}", f"__s_{rule.name}"
        table = given.select(F.col(before).cast("string").alias(key), F.col(after).cast("string").alias(new)).where(F.col(key).isNotNull())
        table = materialise(table.groupBy(key).agg(F.min(new).alias(new)), "mappings")
        table, _, small = sized_for_join(table)
        held = f"__o_{rule.name}"
        left = self.df.withColumn(held, old)
        if small:
            self.df = left.join(table, F.col(held) == F.col(key), "left").drop(key, held)
        else:
            self.df = lookup(left, held, table, key, key_text(*[F.col(k) for k in self.rule.key])).drop(held)
        self.extra.append(new)
        return F.col(new)

    def _math(self, rule: ColumnRule) -> Column:
        sources = [s.strip() for s in (rule.pattern or rule.name).split(",")]
        earlier = [r.name for r in self.rule.columns]
        for source in sources:
            own = len(sources) == 1 and source.upper() == rule.name.upper()
            known = source in earlier and rule.name in earlier
            if not own and (source not in self.df.columns or (known and earlier.index(source) >= earlier.index(rule.name))):
                raise RuleError(f"{rule.name} must come after its source {source}")
            if not isinstance(self.types[source], T.NumericType):
                raise RuleError(f"{source} must be numeric for {rule.operator}")
        self.reads(*sources)
        factor = int(round(float(rule.max))) if rule.max else 0
        value = redact.math_value(rule.operator, [F.col(s) for s in sources], factor, self.staged(rule))
        if value is None:
            raise RuleError(f"{rule.name}: operator {rule.operator!r} has no formula")
        return self.retained(rule, value, "double")

    def _scrambled(self, rule: ColumnRule) -> Column:
        old, kind = F.col(rule.name), self.types[rule.name]
        draws, hold = self.draws(rule), lambda mixed: self.hold(rule, mixed)
        if isinstance(kind, T.StringType):
            return redact.scramble_text(old, draws, hold)
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            return redact.scramble_whole(old, draws, kind.simpleString(), hold)
        if isinstance(kind, T.DecimalType):
            return redact.scramble_decimal(old, draws, kind.simpleString(), hold)
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            return redact.scramble_decimal(old.cast("decimal(38,6)"), draws, "decimal(38,6)", hold).cast(kind)
        raise RuleError(f"{rule.name}: Scramble does not apply to {kind.simpleString()}")

    def _starred(self, rule: ColumnRule) -> Column:
        if not rule.limit():
            raise RuleError(f"{rule.name}: MaskingOut needs a size")
        if not isinstance(self.types[rule.name], T.StringType):
            raise RuleError(f"{rule.name}: MaskingOut applies to text only")
        for name, mask in redact.MASKING_OUT.items():
            if name in (rule.pattern or "").lower():
                old = F.col(rule.name).cast("string")
                return mask(old if rule.retain_null else F.coalesce(old, F.lit("")), rule.limit())
        raise RuleError(f"{rule.name}: unknown masking-out pattern {rule.pattern!r}")

    def _mapped(self, rule: ColumnRule) -> Column:
        """A key mapped one-to-one. Whole numbers stay between ``min`` and ``max``, text keeps its form. Columns of one ``pattern`` (a name for
        the keys they share), or with global mapping of one name, are mapped alike."""
        low = int(rule.min) if rule.min not in (None, "") else 0
        size = rule.limit() - low + 1 if rule.limit() is not None else KEY_NUMBERS.get(self.types[rule.name].simpleString(), 10**15)
        return mapped_key(F.col(rule.name), self.types[rule.name], rule.pattern or self.scope(rule), self.settings, low, size, low)

    def _geometry(self, rule: ColumnRule) -> Column:
        old, draws = F.col(rule.name), self.draws(rule)
        if rule.type == "Geometry":
            kind = self.types[rule.name]["ordinates"].dataType.elementType.simpleString()
            return geometry_random(old, draws, kind)
        return geometry_shuffle(old, draws)

    def apply(self, rule: ColumnRule) -> None:
        """Apply one rule that is neither ignored, computed nor a location column."""
        self.reads(rule.name)
        name, kind = rule.name, rule.type
        if kind in _UNCHANGED or kind in _NO_GENERATOR or rule.unmask:
            return
        own_kind = self.types[name].simpleString()
        if rule.use_value:
            self.put(name, *use_value(rule))
        elif rule.unique and (rule.local_mapping or rule.global_mapping):
            self.put(name, self.retained(rule, self._mapped(rule), own_kind), own_kind)
        elif rule.unique:
            self.flush()
            self.df = mask_unique(self.df, rule, self.rule.key, self.scope(rule), self.sized())
        elif kind in _SHUFFLES:
            self.flush()
            self.df = shuffle_column(
                self.df, name, self.rule.key, self.scope(rule), self.sized(), rule.retain_null, self.source
            )
        elif kind in ("Geometry", "Shufflegeometry"):
            self.put(name, self._geometry(rule), own_kind)
        elif kind == "math":
            self.put(name, self._math(rule), "double")
        elif kind == "MaskingOut":
            self.put(name, self.retained(rule, self._starred(rule), "string"), "string")
        elif kind == "Scramble":
            self.put(name, self.retained(rule, self._scrambled(rule)), own_kind)
        elif kind == "Blob":
            self.reads(rule.pattern)
            file_name = F.col(rule.pattern) if rule.pattern else F.lit("")
            self.put(name, mask_blob(F.col(name), file_name, self.draws(rule), rule.retain_null), "binary")
        elif kind == "Ignore":
            self.put(name, F.lit(None).cast(self.types[name]), own_kind)
        elif kind == "exception":
            value, value_kind = self.generated(rule)
            long = F.length(F.col(name)) > int(rule.pattern)
            self.put(name, F.when(long, value).otherwise(F.col(name)), value_kind)
        else:
            value, value_kind = self.generated(rule)
            self.put(name, self.retained(rule, value, value_kind), value_kind)

    def _is_location(self, rule: ColumnRule) -> bool:
        book = self.settings.address_book
        if book is not None and self.settings.country is None and rule.type.lower() in COORDINATES and rule.type.lower() in book.columns:
            return not rule.unique
        return (
            (self.settings.address_book is not None or self.settings.country is not None)
            and rule.location_word() is not None
            and not rule.unique
            and rule.type not in _BEFORE_LOCATION | _SHUFFLES | _UNCHANGED
        )

    def build(self) -> DataFrame:
        if not self.rule.key:
            raise RuleError(f"{self.rule.name}: a table without a key cannot be masked, its rows would all draw the same values")
        names = self.df.columns
        active = [r for r in self.rule.columns if not r.ignore]
        row_rules = [r for r in active if r.type != "Computed"]
        places = [r for r in row_rules if self._is_location(r)]
        for rule in row_rules:
            if rule in places:
                if rule is places[0]:
                    self.flush()
                    self.df = self.placed(places)
            else:
                self.tried(rule, self.apply)
        for rule in active:
            if rule.type == "Computed":
                self.tried(rule, lambda r: self.compute(r, names))
        self.flush()
        return self.df

    def placed(self, places: list[ColumnRule]) -> DataFrame:
        if self.settings.country:
            return location_by_country(self.df, places, self.rule.key, self.rule.name, self.settings.country, self.settings)
        return location_record(self.df, places, self.rule.key, self.rule.name, self.settings)

    def compute(self, rule: ColumnRule, names: list[str]) -> None:
        missing = [s for s in rule.source_columns if s not in names]
        if missing:
            raise RuleError(f"{rule.name}: source column {missing[0]} could not be found")
        self.reads(*rule.source_columns)
        separator = " " if rule.separator is None else rule.separator
        self.put(rule.name, redact.computed([F.col(s) for s in rule.source_columns], separator), "string")

    def tried(self, rule: ColumnRule, apply) -> None:
        """Apply a rule. Where failures are collected, one that cannot be applied is noted and leaves its column as it is."""
        try:
            if rule.name not in self.types and rule.type != "Computed":
                raise RuleError(f"{rule.name}: no such column")
            apply(rule)
        except RuleError as fault:
            if self.failures is None:
                raise
            self.failures[rule.name] = str(fault)


def mask_table(
    df: DataFrame, rule: TableRule, settings: Settings = Settings(), keep_types: bool = True, failures: dict[str, str] | None = None
) -> DataFrame:
    """Apply the rules of a table. ``keep_types`` casts every masked value to the type of its column.

    A rule that cannot be applied is an error. With ``failures`` it is noted there (column to reason) and the others go on.
    """
    return TableMask(df, rule, settings, keep_types, failures).build()
