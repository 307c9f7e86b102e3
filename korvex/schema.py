"""Collection schemas and their Spark types."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import types as T

from .errors import InvalidInput, NotFound

#: Unsigned types have no Spark counterpart and take the next wider one; their ranges are checked on write.
SCALARS: dict[str, T.DataType] = {
    "string": T.StringType(),
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "uint32": T.LongType(),
    "uint64": T.DecimalType(20, 0),
    "float": T.FloatType(),
    "float64": T.DoubleType(),
    "bool": T.BooleanType(),
}
UNSIGNED_MAX = {"uint32": 2**32 - 1, "uint64": 2**64 - 1}
DENSE = {"vector_fp32", "vector_fp16"}
SPARSE = "vector_sparse"
SPARSE_TYPE = T.StructType([T.StructField("indices", T.ArrayType(T.LongType())), T.StructField("values", T.ArrayType(T.FloatType()))])
METRICS = ("l2", "ip", "cosine")
WIDENINGS = {("int32", "int64"), ("uint32", "uint64"), ("float", "float64")}


def metric_name(name: str) -> str:
    lowered = str(name).lower()
    if lowered not in METRICS:
        raise InvalidInput(f"unknown metric {name!r}")
    return lowered


@dataclass
class Field:
    name: str
    type: str
    nullable: bool = False
    array: bool = False

    def __post_init__(self):
        if self.type not in SCALARS:
            raise InvalidInput(f"unknown field type {self.type!r}")

    def spark(self) -> T.DataType:
        return T.ArrayType(SCALARS[self.type], True) if self.array else SCALARS[self.type]


@dataclass
class Vector:
    name: str
    dimension: int
    type: str = "vector_fp32"
    metric: str | None = None

    def __post_init__(self):
        if self.type == SPARSE:
            if self.dimension != 0:
                raise InvalidInput("a sparse vector has dimension 0")
        elif self.type in DENSE:
            if self.dimension <= 0:
                raise InvalidInput("a dense vector needs a positive dimension")
        else:
            raise InvalidInput(f"unknown vector type {self.type!r}")
        if self.metric is not None:
            self.metric = metric_name(self.metric)

    @property
    def sparse(self) -> bool:
        return self.type == SPARSE

    def spark(self) -> T.DataType:
        return SPARSE_TYPE if self.sparse else T.ArrayType(T.FloatType(), True)


@dataclass
class CollectionSchema:
    primary_vector: str
    vectors: list[Vector]
    fields: list[Field] = field(default_factory=list)
    metric: str = "l2"

    def __post_init__(self):
        self.metric = metric_name(self.metric)
        names = [x.name for x in [*self.fields, *self.vectors]]
        if len(set(names)) != len(names):
            raise InvalidInput("a name is used twice")
        if {"id", "op_seq", "is_deleted"} & set(names):
            raise InvalidInput("id, op_seq and is_deleted are reserved")
        primary = next((v for v in self.vectors if v.name == self.primary_vector), None)
        if primary is None or primary.sparse:
            raise InvalidInput("the primary vector must be one of the dense vectors")

    def vector(self, name: str) -> Vector:
        for v in self.vectors:
            if v.name == name:
                return v
        raise NotFound(f"no vector field {name!r}")

    def field(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    def metric_of(self, name: str) -> str:
        return self.vector(name).metric or self.metric

    def spark(self) -> T.StructType:
        out = [T.StructField("id", T.LongType(), False)]
        out += [T.StructField(f.name, f.spark(), True) for f in self.fields]
        out += [T.StructField(v.name, v.spark(), True, {"dimension": v.dimension}) for v in self.vectors]
        return T.StructType(out)

    def to_dict(self) -> dict:
        return asdict(self)

    @staticmethod
    def from_dict(d: dict) -> CollectionSchema:
        return CollectionSchema(d["primary_vector"], [Vector(**v) for v in d["vectors"]], [Field(**f) for f in d["fields"]], d["metric"])


def infer_schema(spark_schema: T.StructType, dimensions: dict[str, int], id_column: str = "id", metric: str = "l2") -> CollectionSchema:
    """A collection schema for a DataFrame: float lists of known dimension become vectors; the primary one is ``dense``
    if there is such a column, else the first."""
    kinds = {T.StringType: "string", T.IntegerType: "int32", T.LongType: "int64", T.FloatType: "float", T.DoubleType: "float64", T.BooleanType: "bool"}
    fields, vectors = [], []
    for f in spark_schema.fields:
        if f.name == id_column:
            continue
        if f.name in dimensions and isinstance(f.dataType, T.ArrayType):
            vectors.append(Vector(f.name, dimensions[f.name]))
        elif f.dataType == SPARSE_TYPE:
            vectors.append(Vector(f.name, 0, SPARSE))
        elif isinstance(f.dataType, T.ArrayType) and type(f.dataType.elementType) in kinds:
            fields.append(Field(f.name, kinds[type(f.dataType.elementType)], f.nullable, True))
        elif type(f.dataType) in kinds:
            fields.append(Field(f.name, kinds[type(f.dataType)], f.nullable))
        else:
            raise InvalidInput(f"column {f.name!r} has no collection type")
    dense = [v.name for v in vectors if not v.sparse]
    if not dense:
        raise InvalidInput("a primary vector is needed")
    return CollectionSchema("dense" if "dense" in dense else dense[0], vectors, fields, metric)
