from salesloom.settings import BUSINESS_COLUMNS

RAW_SCHEMA = ", ".join(f"{c} string" for c in BUSINESS_COLUMNS)

VALID = ("2024-05-21", "Nadia Petit", "Bretagne", "Tablette", "Mobile", "4", "250.0", "0.2", "Livré")


def raw_frame(spark, rows, source=None):
    """Text lines; with ``source`` every row ends with its file name."""
    schema = RAW_SCHEMA + (", source_fichier string" if source else "")
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def line(**changes):
    """The valid line with some columns replaced."""
    values = dict(zip(BUSINESS_COLUMNS, VALID))
    values.update(changes)
    return tuple(values[c] for c in BUSINESS_COLUMNS)


def rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()
