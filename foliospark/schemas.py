"""The shapes of the engine's records."""

from __future__ import annotations

from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType())])
DETECTION = T.StructType([T.StructField("page", T.IntegerType()), T.StructField("det", T.IntegerType()), T.StructField("quad", T.ArrayType(POINT))])
REGION = T.StructType([T.StructField(n, T.IntegerType()) for n in ("page", "pos", "x", "y", "w", "h")] + [T.StructField("lang", T.StringType())])
REQUEST = T.StructType(
    [
        T.StructField("contexto_previo", T.ArrayType(T.ArrayType(T.StringType()))),
        T.StructField("textos_a_traducir", T.ArrayType(T.StructType([T.StructField("id", T.IntegerType()), T.StructField("texto", T.StringType())]))),
    ]
)
RESPONSE = T.StructType(
    [T.StructField("traducciones", T.ArrayType(T.StructType([T.StructField("id", T.IntegerType()), T.StructField("traduccion", T.StringType())])))]
)
MESSAGE = T.StructType([T.StructField("seq", T.LongType()), T.StructField("doc", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("payload", T.StringType())])
BALLOON = T.StructType([T.StructField("Coordenadas", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("Texto", T.StringType())])
PAGE = T.StructType([T.StructField("Página", T.IntegerType()), T.StructField("Formato", T.StringType()), T.StructField("Globos de texto", T.ArrayType(BALLOON))])


def document(list_name: str) -> T.StructType:
    """A title's document; list_name: Transcripción or Traducción."""
    return T.StructType([T.StructField("Título", T.StringType()), T.StructField("Páginas", T.IntegerType()), T.StructField(list_name, T.ArrayType(PAGE))])
