"""Declared schemas of the graph's tables. Nothing is inferred."""

from pyspark.sql import types as T


_L, _S, _D, _I, _B, _TS = T.LongType(), T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType(), T.TimestampType()


def _of(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


POINT = _of(x=_D, y=_D, z=_D, w=_D)
TABLES: dict[str, T.StructType] = {
    "code_points": _of(codepoint=_I, name=_S, general_category=_S, block=_S, age=_S, script=_S, properties=_S, base_codepoint=_I, radical=_I, strokes=_I),
    "collation_weights": _of(source_codepoints=T.ArrayType(_I), primary_weight=_I, secondary_weight=_I, tertiary_weight=_I),
    "tenant": _of(id=_S, name=_S, active=_B, quota=_L),
    "tenant_user": _of(id=_S, tenant_id=_S, name=_S, role=_S, active=_B),
    "content": _of(id=_S, tenant_id=_S, user_id=_S, content_type=_I, content_hash=_S, size=_L, mime=_S, language=_S, source=_S, encoding=_S, created_at=_TS, modified_at=_TS, validated_at=_TS),
    "physicality": _of(id=_S, hilbert=T.BinaryType(), x=_D, y=_D, z=_D, w=_D, trajectory=T.ArrayType(POINT)),
    "atom": _of(id=_S, codepoint=_I, physicality_id=_S),
    "composition": _of(id=_S, physicality_id=_S),
    "composition_sequence": _of(id=_S, composition_id=_S, atom_id=_S, ordinal=_L, occurrences=_L),
    "relation": _of(id=_S, physicality_id=_S),
    "relation_sequence": _of(id=_S, relation_id=_S, composition_id=_S, ordinal=_L, occurrences=_L),
    "relation_rating": _of(relation_id=_S, observations=_L, rating=_D, k_factor=_D),
    "relation_evidence": _of(id=_S, content_id=_S, relation_id=_S, is_valid=_B, source_rating=_D, signal_strength=_D, validated_at=_TS),
    "model_projection": _of(id=_S, composition_id=_S, content_id=_S, x=_D, y=_D, z=_D, w=_D),
}
#: Defaults of the rating table: first observation, first rating, K.
RATING_DEFAULTS = {"observations": 1, "rating": 1000.0, "k_factor": 1.0}
