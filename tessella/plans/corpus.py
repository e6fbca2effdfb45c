"""A corpus of papers written from keys of the star schema by plain concatenation, alike in Spark and in SQL.

The test documents hold invented words without figures, numbers or directions; these papers hold all of them. One paper stands for each brand of part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import spread

#: Papers as SQL that both engines run: doc_id, ord, paragraph_id, section_title, section_type, text, page_no.
#: Every part is a results paragraph; every seventh part's paper also gets a caption, a discussion and a continuation. Figures 6 to 8 of each
#: paper have an association with its discussion, a caption alone, and neither caption nor result.
PARAGRAPHS = """
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part, k, j) AS INT) AS ord, concat(doc_id, '-', CAST(part AS STRING), '-', CAST(k AS STRING), '-', CAST(j AS STRING)) AS paragraph_id,
  section_title, section_type, text, CAST(1 + part AS INT) AS page_no
FROM (
  SELECT p_brand AS doc_id, 0 AS part, min(p_partkey) AS k, 0 AS j, 'Introduction' AS section_title, 'introduction' AS section_type,
    concat('Gene ', chr(CAST(65 + min(p_partkey) % 26 AS INT)), ' is a key regulator of cellular metabolism. Brand ', p_brand, ' is studied in cells.') AS text
  FROM part GROUP BY p_brand
  UNION ALL
  SELECT p_brand, 1, min(p_partkey), 0, 'Materials and Methods', 'methods',
    concat('Cells were divided into control and treatment groups. Cells in the treatment group received Treatment A for ', CAST(1 + min(p_size) AS STRING), ' hours. Expression of gene levels was measured with body weight.')
  FROM part GROUP BY p_brand
  UNION ALL
  SELECT p_brand, 2, p_partkey, 0, 'Results', 'results',
    concat('Treatment ', chr(CAST(65 + p_size % 4 AS INT)), CASE p_size % 4 WHEN 0 THEN ' significantly increased' WHEN 1 THEN ' decreased' WHEN 2 THEN ' was associated with increased' ELSE ' significantly reduced' END,
      ' expression of gene ', chr(CAST(87 + p_size % 3 AS INT)), ' compared with control',
      CASE WHEN p_partkey % 3 = 0 THEN concat(' by ', CAST(p_size AS STRING), '%') ELSE '' END,
      CASE WHEN p_partkey % 4 = 0 THEN concat(' (p < 0.0', CAST(1 + p_size % 5 AS STRING), ')') ELSE '' END,
      ' (Figure ', CAST(p_partkey % 5 + 1 AS STRING), CASE WHEN p_partkey % 6 = 0 THEN 'b' ELSE '' END, ').')
  FROM part WHERE p_partkey % 7 <> 3
  UNION ALL
  SELECT p_brand, 2, p_partkey, 1, 'Results', 'results', concat('The samples of lot ', CAST(p_partkey AS STRING), ' were analyzed as described previously.')
  FROM part WHERE p_partkey % 7 = 3
  UNION ALL
  SELECT p_brand, 3, min(p_partkey), CAST(p_partkey % 5 AS INT), 'Results', 'results',
    concat('Figure ', CAST(p_partkey % 5 + 1 AS STRING), '. Relative expression of gene ', chr(CAST(87 + p_partkey % 5 % 3 AS INT)), ' in control and treatment groups.')
  FROM part GROUP BY p_brand, p_partkey % 5
  UNION ALL
  SELECT p_brand, 4, p_partkey, 0, 'Discussion', 'discussion',
    concat('Our findings for Figure ', CAST(p_partkey % 5 + 1 AS STRING), ' suggest that Treatment ', chr(CAST(65 + p_size % 4 AS INT)), ' promotes gene expression in cultured cells.')
  FROM part WHERE p_partkey % 11 = 0
  UNION ALL
  SELECT p_brand, 5, min(p_partkey), 0, 'Results', 'results', 'Treatment E was associated with increased expression of gene V compared with control (Figure 6).' FROM part GROUP BY p_brand
  UNION ALL
  SELECT p_brand, 5, min(p_partkey), 1, 'Results', 'results', 'Figure 6. Relative expression of gene V in control and treatment groups.' FROM part GROUP BY p_brand
  UNION ALL
  SELECT p_brand, 5, min(p_partkey), 2, 'Results', 'results', 'Figure 7. Relative expression of gene V in control and treatment groups.' FROM part GROUP BY p_brand
  UNION ALL
  SELECT p_brand, 5, min(p_partkey), 3, 'Results', 'results', 'Figure 8 shows the apparatus of the assay.' FROM part GROUP BY p_brand
  UNION ALL
  SELECT p_brand, 6, min(p_partkey), 0, 'Discussion', 'discussion', 'Our findings for Figure 6 suggest that Treatment E promotes gene expression in cultured cells.' FROM part GROUP BY p_brand
) q
"""


def over_part(spark: SparkSession, sf_dir: str, sql: str, *deal: str) -> DataFrame:
    """SQL over the table `part` of a folder, which is named in this query alone. deal: columns by which its rows are spread over tasks."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return spark.sql(sql.replace("FROM part", "FROM {part}"), part=spread(part, *deal) if deal else part)


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over_part(spark, sf_dir, PARAGRAPHS)


def oracle_cte(name: str = "papers") -> str:
    """The papers as a common table of DuckDB's SQL."""
    return f"{name} AS ({PARAGRAPHS.replace('AS STRING', 'AS VARCHAR')})"
