"""SQL of the tables of the written papers (plans.corpus), each made from the papers' own sentences and not from the operators' patterns.

The papers' sentences are of few forms, so that plain conditions say what the operators' patterns find in them."""

from __future__ import annotations

from ..functions import patterns as P
from . import corpus

#: Evidence: caption, anchors, three continuations, the methods paragraph, discussion; twelve for each figure. Panels have the paragraphs that cite them.
EVIDENCE = rf"""{corpus.oracle_cte()},
cap AS (SELECT doc_id, regexp_extract(text, '^Figure (\d+)\.', 1) AS num, paragraph_id, ord, text FROM papers WHERE regexp_matches(text, '^Figure \d+\.')),
men AS (SELECT doc_id, ord, paragraph_id, section_type, text, regexp_extract(text, 'Figure (\d+)', 1) AS num, regexp_extract(text, 'Figure \d+([a-z])', 1) AS panel FROM papers WHERE regexp_matches(text, 'Figure \d') AND NOT regexp_matches(text, '^Figure \d+\.')),
fig AS (SELECT doc_id, num FROM cap UNION SELECT doc_id, num FROM men),
fl AS (SELECT doc_id, ord, paragraph_id, text, CASE WHEN regexp_matches(text, 'Figure \d+') THEN regexp_extract(text, 'Figure (\d+)', 1) END AS first FROM papers WHERE section_type = 'results'),
ow AS (SELECT *, last_value(first IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS num FROM fl),
dir AS (SELECT doc_id, num, CASE WHEN first IS NULL THEN 3 ELSE 2 END AS prio, ord, paragraph_id, text FROM ow WHERE num IS NOT NULL
  UNION ALL SELECT doc_id, num, 4, ord, paragraph_id, text FROM men WHERE section_type NOT IN ('methods', 'discussion')),
one AS (SELECT * FROM dir QUALIFY row_number() OVER (PARTITION BY doc_id, num, paragraph_id ORDER BY prio, ord) = 1),
few AS (SELECT * FROM one QUALIFY prio <> 3 OR row_number() OVER (PARTITION BY doc_id, num, prio ORDER BY ord) <= 3),
lead12 AS (SELECT * FROM (SELECT doc_id, num, 1 AS prio, ord, paragraph_id, text FROM cap UNION ALL SELECT * FROM few) QUALIFY row_number() OVER (PARTITION BY doc_id, num ORDER BY prio, ord) <= 12),
every AS (SELECT * FROM lead12 UNION ALL SELECT DISTINCT l.doc_id, l.num, 5, p.ord, p.paragraph_id, p.text FROM lead12 l JOIN papers p ON p.doc_id = l.doc_id AND p.section_type = 'methods' WHERE contains(l.text, 'expression of gene')
  UNION ALL SELECT doc_id, num, 6, ord, paragraph_id, text FROM men WHERE section_type = 'discussion'),
fev AS (SELECT doc_id, 'f0' || num AS unit, num, '' AS panel, prio, paragraph_id, text, row_number() OVER (PARTITION BY doc_id, num ORDER BY prio, ord) AS n FROM every QUALIFY n <= 12),
pev AS (SELECT doc_id, 'f0' || num || panel AS unit, num, panel, 7 AS prio, paragraph_id, text, row_number() OVER (PARTITION BY doc_id, num, panel ORDER BY ord) AS n FROM men WHERE panel <> '' AND section_type NOT IN ('methods', 'discussion') QUALIFY n <= 12),
ev AS (SELECT *, 'ev_' || unit || '_' || lpad(n::VARCHAR, 3, '0') AS evidence_id, CASE prio WHEN 1 THEN 'caption' WHEN 5 THEN 'supporting' WHEN 6 THEN 'interpretation' ELSE 'direct' END AS role,
  CASE prio WHEN 2 THEN 'anchor' WHEN 3 THEN 'continuation' WHEN 4 THEN 'anchor' ELSE '' END AS assignment,
  CASE prio WHEN 1 THEN 'experimental_design' WHEN 5 THEN 'experimental_design' WHEN 6 THEN 'author_interpretation' ELSE 'direct_observation' END AS evidence_type
  FROM (SELECT * FROM fev UNION ALL SELECT * FROM pev)),
unit AS (SELECT f.doc_id, 'f0' || f.num AS unit, f.num, '' AS panel, c.text AS caption FROM fig f LEFT JOIN cap c USING (doc_id, num) UNION ALL SELECT DISTINCT doc_id, 'f0' || num || panel, num, panel, NULL FROM men WHERE panel <> '')"""

#: Observations of results paragraphs and interpretations of discussion.
STATEMENTS = rf"""{EVIDENCE},
ob AS (SELECT doc_id, unit, n, text AS statement, CASE WHEN contains(text, 'increased') THEN 'increase' ELSE 'decrease' END AS direction, CASE WHEN contains(text, 'significantly') THEN 'significant' ELSE 'unspecified' END AS significance,
  CASE WHEN contains(text, 'associated with') THEN 'association' ELSE 'causal' END AS relationship, nullif(regexp_extract(text, 'p < [\d.]+'), '') AS p_value, evidence_id, row_number() OVER (PARTITION BY doc_id, unit ORDER BY n) AS i
  FROM ev WHERE role = 'direct' AND text LIKE 'Treatment %'),
it AS (SELECT doc_id, unit, text AS statement, 'increase' AS direction, 'unspecified' AS relationship, evidence_id, row_number() OVER (PARTITION BY doc_id, unit ORDER BY n) AS i FROM ev WHERE role = 'interpretation')"""

#: Terms by role (direct, caption, supporting, interpretation), evidence, pattern and place; a slot lists the different ones as they first stand.
SLOTS = rf"""{STATEMENTS},
po AS (SELECT doc_id, unit, n, text, role, CASE role WHEN 'direct' THEN 0 WHEN 'caption' THEN 1 WHEN 'supporting' THEN 2 ELSE 3 END AS rank FROM ev WHERE assignment <> 'continuation'),
tm AS (SELECT doc_id, unit, 'groups' AS slot, rank, n, 0 AS phase, 'Treatment ' || regexp_extract(text, 'Treatment ([A-Z])', 1) AS v FROM po WHERE regexp_matches(text, 'Treatment [A-Z]')
  UNION ALL SELECT doc_id, unit, 'groups', rank, n, 1, 'treatment' FROM po WHERE role = 'supporting'
  UNION ALL SELECT doc_id, unit, 'controls', rank, n, 0, 'control' FROM po WHERE contains(text, 'control')
  UNION ALL SELECT doc_id, unit, 'ends', rank, n, 0, 'gene ' || regexp_extract(text, 'expression of gene ([A-Z])', 1) || ' expression' FROM po WHERE regexp_matches(text, 'expression of gene [A-Z]')
  UNION ALL SELECT doc_id, unit, 'ends', rank, n, 0, 'body weight' FROM po WHERE role = 'supporting' UNION ALL SELECT doc_id, unit, 'ends', rank, n, 1, 'gene levels expression' FROM po WHERE role = 'supporting'
  UNION ALL SELECT doc_id, unit, 'ends', rank, n, 0, 'gene expression' FROM po WHERE role = 'interpretation'
  UNION ALL SELECT doc_id, unit, 'subjects', 0, 0, 0, 'cells' FROM po WHERE role IN ('supporting', 'interpretation')
  UNION ALL SELECT doc_id, unit, 'stats', 0, n, 0, replace(regexp_extract(text, 'p < [\d.]+'), ' ', '') FROM po WHERE role = 'direct' AND contains(text, 'p <')),
ft AS (SELECT doc_id, unit, slot, min(v) AS v, min((rank, n, phase)) AS place FROM tm GROUP BY doc_id, unit, slot, lower(v)),
sl AS (SELECT doc_id, unit, slot, list(v ORDER BY place) AS vs FROM ft GROUP BY doc_id, unit, slot),
ex AS (SELECT u.*, coalesce(list_filter(g.vs, lambda x: lower(x) <> 'treatment')[1], g.vs[1], '') AS intervention, coalesce(g.vs, []) AS groups, coalesce(c.vs, []) AS controls, coalesce(e.vs, []) AS ends, coalesce(s.vs, []) AS subjects, coalesce(t.vs, []) AS stats
  FROM unit u LEFT JOIN sl g ON g.doc_id = u.doc_id AND g.unit = u.unit AND g.slot = 'groups' LEFT JOIN sl c ON c.doc_id = u.doc_id AND c.unit = u.unit AND c.slot = 'controls' LEFT JOIN sl e ON e.doc_id = u.doc_id AND e.unit = u.unit AND e.slot = 'ends'
  LEFT JOIN sl s ON s.doc_id = u.doc_id AND s.unit = u.unit AND s.slot = 'subjects' LEFT JOIN sl t ON t.doc_id = u.doc_id AND t.unit = u.unit AND t.slot = 'stats')"""

#: Conclusions of different statements, and verdicts by the weights of the slots that are filled.
VERDICTS = rf"""{SLOTS},
cs AS (SELECT o.*, intervention || CASE WHEN relationship = 'association' THEN ' is associated with ' || direction || 'd ' ELSE ' ' || direction || 's ' END || ends[1] || '.' AS told FROM ob o JOIN ex USING (doc_id, unit) WHERE intervention <> '' AND len(ends) > 0),
cd AS (SELECT * FROM cs QUALIFY row_number() OVER (PARTITION BY doc_id, unit, told ORDER BY i) = 1),
cl AS (SELECT *, row_number() OVER (PARTITION BY doc_id, unit ORDER BY i) AS c FROM cd),
li AS (SELECT l.doc_id, l.unit, l.c, string_agg('int_' || lpad(it.i::VARCHAR, 3, '0'), ',' ORDER BY it.i) AS ids FROM cl l JOIN it ON it.doc_id = l.doc_id AND it.unit = l.unit AND it.direction = l.direction GROUP BY ALL),
ot AS (SELECT doc_id, unit, bool_or(significance = 'significant') AS sig FROM ob GROUP BY ALL),
hs AS (SELECT e.*, coalesce(caption, '') <> '' AS h1, intervention <> '' AS h2, len(ends) > 0 AS h3, len(groups) > 0 AND len(controls) > 0 AS h4, ot.doc_id IS NOT NULL AS h5, coalesce(sig, false) AS h6 FROM ex e LEFT JOIN ot USING (doc_id, unit)),
vd AS (SELECT *, CASE WHEN h1 AND (h4 OR (h2 AND h3)) AND h5 THEN 'SUFFICIENT' WHEN h1 OR h4 OR h3 OR h5 THEN 'PARTIAL' ELSE 'INSUFFICIENT' END AS status,
  round(0.2 * h1::INT + 0.15 * h2::INT + 0.15 * h3::INT + 0.15 * h4::INT + 0.25 * h5::INT + 0.1 * h6::INT, 2)::DOUBLE AS confidence FROM hs)"""

#: Blueprints: three of results, three of the design, one prediction for a figure, four of data.
BLUEPRINTS = rf"""{VERDICTS},
ds0 AS (SELECT doc_id, unit, n, evidence_id, unnest(list_filter([nullif(regexp_extract(text, '\d+%'), ''), nullif(regexp_extract(text, 'p < [\d.]+'), '')], lambda x: x IS NOT NULL)) AS value FROM ev WHERE role = 'direct' AND assignment <> 'continuation' AND text LIKE 'Treatment %'),
ds1 AS (SELECT *, CASE WHEN contains(value, '%') THEN 'percentage' ELSE 'p_value' END AS kind, row_number() OVER (PARTITION BY doc_id, unit ORDER BY n, contains(value, '%') DESC) AS f FROM ds0),
des AS (SELECT doc_id, unit, string_agg(evidence_id, ',' ORDER BY n) AS ids FROM ev WHERE evidence_type = 'experimental_design' GROUP BY ALL),
lv AS (SELECT v.*, coalesce(d.ids, '') AS ids, CASE WHEN panel = '' THEN 'Figure ' || num ELSE num || panel END AS label, CASE WHEN len(groups) > 0 THEN groups[1] ELSE intervention END AS grp, coalesce(ends[1], '') AS dv, coalesce(controls[1], '') AS control
  FROM vd v LEFT JOIN des d USING (doc_id, unit) WHERE status <> 'INSUFFICIENT' AND EXISTS (SELECT 1 FROM vd w WHERE w.doc_id = v.doc_id AND w.num = v.num AND w.panel = '' AND w.status <> 'INSUFFICIENT')),
ri AS (SELECT l.*, o.i AS sub, o.relationship, o.direction, o.evidence_id FROM lv l JOIN ob o USING (doc_id, unit) WHERE o.i <= 3 AND intervention <> '' AND dv <> ''),
ria AS (SELECT r.*, (SELECT min_by(told, (CASE WHEN c.evidence_id = r.evidence_id THEN 0 ELSE 1 END, c.c)) FROM cl c WHERE c.doc_id = r.doc_id AND c.unit = r.unit) AS told FROM ri r),
pr AS (SELECT l.*, o.i, o.direction, o.evidence_id FROM lv l JOIN ob o USING (doc_id, unit) WHERE panel = '' AND status = 'SUFFICIENT' AND len(groups) > 0 AND control <> '' AND dv <> '' AND o.relationship = 'causal' QUALIFY row_number() OVER (PARTITION BY l.doc_id, l.unit ORDER BY o.i) = 1),
bp AS (
  SELECT doc_id, unit, num, panel, 0 AS phase, sub, 'RESULT_INTERPRETATION' AS question_type, 'ri' AS abbr, CASE WHEN relationship = 'association' THEN 'What is the relationship between ' || intervention || ' and ' || dv || ' shown in ' || label || '?'
    ELSE 'What does ' || label || ' show about ' || dv || ' in ' || grp || ' compared with the ' || control || ' group?' END AS focus, told AS expected_answer, evidence_id || CASE WHEN ids = '' THEN '' ELSE ',' || ids END AS evidence_ids, confidence, NULL AS kind FROM ria
  UNION ALL SELECT doc_id, unit, num, panel, 1, 1, 'EXPERIMENTAL_DESIGN', 'ed', 'Why does the experiment in ' || label || ' include a ' || control || ' group?', 'The ' || control || ' group provides the baseline level of ' || dv || ' against which ' || intervention || ' is compared.', ids, confidence, NULL FROM lv WHERE panel = '' AND len(groups) > 0 AND control <> '' AND dv <> '' AND ids <> ''
  UNION ALL SELECT doc_id, unit, num, panel, 1, 2, 'EXPERIMENTAL_DESIGN', 'ed', 'What is the purpose of the ' || groups[1] || ' group in ' || label || '?', 'The ' || groups[1] || ' group receives ' || intervention || ' so that its effect on ' || dv || ' can be measured against the ' || control || ' baseline.', ids, confidence, NULL FROM lv WHERE panel = '' AND len(groups) > 0 AND control <> '' AND dv <> '' AND ids <> ''
  UNION ALL SELECT doc_id, unit, num, panel, 1, 3, 'EXPERIMENTAL_DESIGN', 'ed', 'What does the experiment shown in ' || label || ' measure?', 'It measures ' || dv || ' in the ' || groups[1] || ' group versus the ' || control || ' group.', ids, confidence, NULL FROM lv WHERE panel = '' AND len(groups) > 0 AND control <> '' AND dv <> '' AND ids <> ''
  UNION ALL SELECT doc_id, unit, num, panel, 2, 1, 'SIMPLE_PREDICTION', 'pred', 'If ' || intervention || ' were applied to the ' || control || ' group, what would happen to ' || dv || '?', dv || ' would ' || direction || ', as already observed in the ' || groups[1] || ' group.', evidence_id || CASE WHEN ids = '' THEN '' ELSE ',' || ids END, confidence, NULL FROM pr
  UNION ALL SELECT l.doc_id, l.unit, l.num, l.panel, 3, f, 'DATA_STATEMENT', 'ds', 'According to ' || label || ', what quantitative value is explicitly reported for ' || CASE WHEN dv <> '' THEN 'the reported change in ' || dv ELSE 'the reported quantitative result' END || '?', d.value, d.evidence_id, confidence, d.kind FROM lv l JOIN ds1 d USING (doc_id, unit) WHERE f <= 4),
bo AS (SELECT *, 'qb_' || unit || '_' || abbr || '_' || lpad((row_number() OVER (PARTITION BY doc_id, unit, question_type ORDER BY phase, sub))::VARCHAR, 3, '0') AS blueprint_id, row_number() OVER (PARTITION BY doc_id ORDER BY num, panel <> '', unit, phase, sub) AS ord FROM bp)"""

SKIPS = rf"""{BLUEPRINTS},
sk AS (
  SELECT l.doc_id, 'RESULT_INTERPRETATION' AS question_type, CASE WHEN NOT h5 THEN 'no_directed_observation' WHEN intervention = '' OR dv = '' THEN 'missing_intervention_or_endpoint' END AS reason FROM lv l
  UNION ALL SELECT doc_id, 'EXPERIMENTAL_DESIGN', CASE WHEN len(groups) = 0 OR control = '' OR dv = '' THEN 'incomplete_design_slots' WHEN ids = '' THEN 'no_design_evidence' END FROM lv WHERE panel = ''
  UNION ALL SELECT l.doc_id, 'SIMPLE_PREDICTION', CASE WHEN status <> 'SUFFICIENT' THEN 'figure_not_sufficient' WHEN len(groups) = 0 OR control = '' THEN 'missing_group_comparison' WHEN intervention = '' OR dv = '' THEN 'missing_intervention_or_endpoint'
    WHEN NOT h5 THEN 'no_directed_observation' WHEN NOT EXISTS (SELECT 1 FROM ob WHERE ob.doc_id = l.doc_id AND ob.unit = l.unit AND relationship = 'causal') THEN 'non_causal_relationship' END FROM lv l WHERE panel = ''
  UNION ALL SELECT doc_id, 'DATA_STATEMENT', 'no_literal_numeric_value' FROM lv l WHERE NOT EXISTS (SELECT 1 FROM ds1 WHERE ds1.doc_id = l.doc_id AND ds1.unit = l.unit)
  UNION ALL SELECT doc_id, unnest(['RESULT_INTERPRETATION', 'EXPERIMENTAL_DESIGN', 'SIMPLE_PREDICTION', 'DATA_STATEMENT']), 'figure_insufficient' FROM vd WHERE panel = '' AND status = 'INSUFFICIENT'
  UNION ALL SELECT doc_id, unnest(['RESULT_INTERPRETATION', 'DATA_STATEMENT']), 'panel_insufficient' FROM vd v WHERE panel <> '' AND status = 'INSUFFICIENT' AND EXISTS (SELECT 1 FROM vd w WHERE w.doc_id = v.doc_id AND w.num = v.num AND w.panel = '' AND w.status <> 'INSUFFICIENT'))"""

EVIDENCE_COLLECT = f"WITH {EVIDENCE} SELECT doc_id, unit, n::INT AS n, evidence_id, role, assignment, evidence_type, paragraph_id FROM ev"
OBSERVATIONS = f"WITH {STATEMENTS} SELECT doc_id, unit, i::INT AS i, statement, direction, significance, relationship, p_value, evidence_id FROM ob"
INTERPRETATIONS = f"WITH {STATEMENTS} SELECT doc_id, unit, i::INT AS i, 'int_' || lpad(i::VARCHAR, 3, '0') AS interpretation_id, statement, direction, relationship, evidence_id FROM it"
EXPERIMENTS = f"""WITH {SLOTS} SELECT doc_id, unit, intervention, array_to_string(controls, '; ') AS control_groups, array_to_string(groups, '; ') AS experimental_groups, array_to_string(ends, '; ') AS dependent_variables, array_to_string(subjects, '; ') AS subjects,
array_to_string(stats, '; ') AS statistical_results, CASE WHEN intervention <> '' AND len(ends) > 0 THEN 'Does ' || intervention || ' affect ' || ends[1] || '?' ELSE '' END AS research_question FROM ex"""
CONCLUSIONS = f"WITH {VERDICTS} SELECT cl.doc_id, cl.unit, cl.c::INT AS c, told AS statement, relationship, evidence_id, coalesce(ids, '') AS interpretation_ids FROM cl LEFT JOIN li USING (doc_id, unit, c)"
SEMANTIC_GATE = f"""WITH {VERDICTS} SELECT doc_id, unit, status, confidence, CASE WHEN status = 'SUFFICIENT' THEN '' ELSE array_to_string(list_filter([CASE WHEN NOT h1 THEN 'figure caption' END, CASE WHEN NOT h2 THEN 'independent variable / intervention' END, CASE WHEN NOT h3 THEN 'dependent variable / measured endpoint' END,
CASE WHEN NOT h4 THEN 'experimental vs control group comparison' END, CASE WHEN NOT h5 THEN 'direction of change' END, CASE WHEN NOT h6 THEN 'statistical significance' END], lambda x: x IS NOT NULL), '; ') END AS missing FROM vd"""
STATUS_PIVOT = f"WITH {VERDICTS} SELECT doc_id, count(*) FILTER (status = 'SUFFICIENT') AS sufficient, count(*) FILTER (status = 'PARTIAL') AS partial, count(*) FILTER (status = 'INSUFFICIENT') AS insufficient FROM vd GROUP BY doc_id"
EVIDENCE_STORE = f"WITH {EVIDENCE} SELECT doc_id, evidence_type, count(*) AS n FROM ev GROUP BY ALL"
BACKGROUND = f"WITH {corpus.oracle_cte()} SELECT doc_id, 'introduction' AS part, text, '' AS source, 1::INT AS n FROM papers WHERE section_type = 'introduction'"
BLUEPRINT_ROWS = f"WITH {BLUEPRINTS} SELECT doc_id, blueprint_id, question_type, focus, expected_answer, evidence_ids, confidence FROM bo"
BLUEPRINT_TYPES = f"""WITH {BLUEPRINTS} SELECT doc_id, count(*) FILTER (abbr = 'ri') AS result_interpretation, count(*) FILTER (abbr = 'ed') AS experimental_design, count(*) FILTER (abbr = 'pred') AS simple_prediction, count(*) FILTER (abbr = 'ds') AS data_statement, count(*) AS total FROM bo GROUP BY doc_id"""
SKIP_COUNTS = f"WITH {SKIPS} SELECT doc_id, question_type, reason, count(*) AS n FROM sk WHERE reason IS NOT NULL GROUP BY ALL"
NUMERIC_POOL = f"WITH {BLUEPRINTS} SELECT doc_id, kind, expected_answer AS value, min(ord)::INT AS first_ord, min_by(evidence_ids, ord) AS evidence_id FROM bo WHERE abbr = 'ds' GROUP BY ALL"

#: Sets of a figure: the first result, prediction and datum (or design where one lacks), a true statement each and up to four false ones.
DRAFTS = rf"""{BLUEPRINTS},
b1 AS (SELECT bo.*, CASE abbr WHEN 'ri' THEN 0 WHEN 'pred' THEN 1 WHEN 'ds' THEN 2 ELSE 3 END AS kind_no FROM bo WHERE panel = '' QUALIFY row_number() OVER (PARTITION BY bo.doc_id, unit, abbr ORDER BY ord) = 1),
b2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, unit ORDER BY kind_no) AS set_n FROM b1 QUALIFY set_n <= 3),
sp AS (SELECT doc_id, unit, 'Treatment ' || regexp_extract(text, 'Treatment ([A-Z])', 1) AS v, min(n) AS n FROM ev WHERE regexp_matches(text, 'Treatment [A-Z]') GROUP BY ALL),
tr AS (SELECT doc_id, unit, list(v ORDER BY n) AS vs FROM sp GROUP BY ALL),
o1 AS (SELECT doc_id, unit, any_value(direction) AS direction, any_value(significance) AS significance, any_value(relationship) AS relationship FROM ob WHERE i = 1 GROUP BY ALL),
npool AS (SELECT doc_id, kind, expected_answer AS value, min(ord) AS at FROM bo WHERE abbr = 'ds' GROUP BY ALL),
nsib AS (SELECT f.doc_id, f.num, min(g.num) AS sib FROM fig f JOIN fig g ON f.doc_id = g.doc_id AND f.num <> g.num GROUP BY ALL),
qt AS (SELECT doc_id, evidence_id, regexp_replace(regexp_replace(text, '\.+$', ''), '\s*\(Figure \d+[a-z]?\)$', '') AS body FROM ev),
c0 AS (SELECT b.*, e.intervention, e.groups[1] AS g1, e.ends, coalesce(e.controls[1], '') AS control, t.vs AS spans, s.sib, o.direction, o.significance, o.relationship, q.body,
  (SELECT arg_min(p.value, p.at) FROM npool p WHERE p.doc_id = b.doc_id AND p.kind = b.kind AND p.value <> b.expected_answer) AS other_value
  FROM b2 b JOIN ex e USING (doc_id, unit) LEFT JOIN tr t USING (doc_id, unit) LEFT JOIN nsib s ON s.doc_id = b.doc_id AND s.num = b.num LEFT JOIN o1 o USING (doc_id, unit) LEFT JOIN qt q ON q.doc_id = b.doc_id AND q.evidence_id = b.evidence_ids),
c1 AS (SELECT *, CASE WHEN abbr = 'ri' AND significance = 'significant' THEN g1 || ' significantly ' || direction || 's ' || ends[1] || '.' WHEN abbr = 'ds' THEN 'According to Figure ' || num || ', ' || body || '.' ELSE expected_answer END AS t,
  CASE WHEN abbr IN ('ri', 'pred') THEN relationship ELSE 'unspecified' END AS relation, CASE WHEN abbr = 'ri' THEN g1 ELSE intervention END AS x_treatment,
  'qd_' || unit || '_' || lpad(set_n::VARCHAR, 3, '0') AS set_id, CASE abbr WHEN 'ds' THEN NULL WHEN 'ri' THEN list_filter(ends[2:], lambda x: x <> ends[1])[1] ELSE ends[2] END AS other_end FROM c0),
c2 AS (SELECT *, list_filter(spans, lambda x: x <> x_treatment)[1] AS other_treatment FROM c1),
pt AS (
  SELECT c2.*, 1 AS p, 'DIRECTION_FLIP' AS perturbation, CASE WHEN contains(t, 'increase') THEN replace(t, 'increase', 'decrease') ELSE replace(t, 'decrease', 'increase') END AS f FROM c2
  UNION ALL SELECT *, 2, 'SIGNIFICANCE_FLIP', CASE WHEN abbr = 'ri' AND significance = 'significant' THEN regexp_replace(t, ' significantly (increase|decrease)s ', ' does not significantly \1 ') END FROM c2
  UNION ALL SELECT *, 3, 'GROUP_SWAP', CASE WHEN contains(t, g1) AND contains(t, control) AND control <> '' THEN replace(replace(replace(t, g1, chr(1)), control, g1), chr(1), control) END FROM c2
  UNION ALL SELECT *, 4, 'CAUSALITY_UPGRADE', CASE WHEN relation = 'association' AND contains(t, 'is associated with') THEN replace(t, 'is associated with', 'causes') END FROM c2
  UNION ALL SELECT *, 5, 'CONCLUSION_FLIP', CASE WHEN contains(t, 'would increase') OR contains(t, 'would decrease') THEN replace(t, 'would ', 'would not ') WHEN contains(t, 'is associated with') THEN replace(t, 'is associated with', 'is not associated with')
    WHEN contains(t, 'increases') THEN replace(t, 'increases', 'does not increase') WHEN contains(t, 'decreases') THEN replace(t, 'decreases', 'does not decrease') WHEN contains(t, 'provides the baseline') THEN replace(t, 'provides the baseline', 'does not provide the baseline') END FROM c2
  UNION ALL SELECT *, 6, 'DV_SWAP', CASE WHEN contains(t, ends[1]) THEN regexp_replace(t, ends[1], other_end) END FROM c2
  UNION ALL SELECT *, 7, 'VARIABLE_SWAP', CASE WHEN contains(t, x_treatment) THEN regexp_replace(t, x_treatment, other_treatment) END FROM c2
  UNION ALL SELECT *, 8, 'PANEL_MISATTRIBUTION', CASE WHEN starts_with(t, 'According to ') THEN regexp_replace(t, '^According to [^,]+', 'According to Figure ' || sib) ELSE 'According to Figure ' || sib || ', ' || t END FROM c2
  UNION ALL SELECT *, 9, 'NUMERIC_MUTATION', CASE WHEN abbr = 'ds' THEN replace(t, expected_answer, other_value) END FROM c2),
p1 AS (SELECT * FROM pt WHERE f IS NOT NULL AND f <> t QUALIFY row_number() OVER (PARTITION BY doc_id, set_id, f ORDER BY p) = 1),
p2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, set_id ORDER BY p) AS nn FROM p1 QUALIFY nn <= 4),
dr AS (SELECT doc_id, set_id, nn, f AS statement, false AS is_correct, perturbation, evidence_ids, focus, abbr FROM p2
  UNION ALL SELECT doc_id, set_id, 0, t, true, 'NONE', evidence_ids, focus, abbr FROM c2 WHERE EXISTS (SELECT 1 FROM p2 WHERE p2.doc_id = c2.doc_id AND p2.set_id = c2.set_id))"""

DRAFT_SETS = f"WITH {DRAFTS} SELECT doc_id, set_id || '_' || lpad(nn::VARCHAR, 2, '0') AS draft_id, statement, is_correct, perturbation, evidence_ids FROM dr"
PERTURBATION_COUNTS = f"WITH {DRAFTS} SELECT doc_id, perturbation, count(*) AS n FROM dr WHERE NOT is_correct GROUP BY ALL"
REVIEW_OVERVIEW = f"""WITH {DRAFTS}, dx AS (SELECT *, unnest(string_split(evidence_ids, ',')) AS evidence_id FROM dr)
SELECT dx.doc_id, set_id, chr((65 + nn)::INT) AS label, statement, is_correct, dx.evidence_id, left(ev.text, 120) AS preview, focus FROM dx JOIN ev ON ev.doc_id = dx.doc_id AND ev.evidence_id = dx.evidence_id"""

#: Leading sentences: sums of their sizes say which fit, the first in any case.
WORD_BUDGETS = r"""WITH s AS (SELECT doc_id, i, trim(s, ' ' || chr(10)) AS s FROM (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\s+$', ''), chr(1)), lambda x: trim(x, ' ' || chr(10)) <> '') AS l FROM documents))),
n AS (SELECT *, sum(len(regexp_split_to_array(s, '\s+'))) OVER o AS words, sum(length(s) + 1) OVER o - 1 AS chars FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY i))
SELECT d.doc_id, coalesce(string_agg(s, ' ' ORDER BY i) FILTER (i = 1 OR words <= 60), '') AS words60, coalesce(string_agg(s, ' ' ORDER BY i) FILTER (i = 1 OR chars <= 300), '') AS chars300 FROM documents d LEFT JOIN n USING (doc_id) GROUP BY d.doc_id"""

#: An entry's own line holds it but for one letter, so that no entry falls to a line that is only like it.
TOC_RANGE_JOIN = """WITH l AS (SELECT p_brand AS doc_id, p_partkey::INT AS idx, p_size AS page, replace(p_name, ' ', '') AS lt FROM part),
t AS (SELECT p_brand AS doc_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS ord, p_name || 's' AS title, replace(p_name, ' ', '') || 's' AS target, p_size + p_partkey % 2 AS page FROM part),
s AS (SELECT l.doc_id, idx, ord, title, CASE WHEN lt = target THEN 3.0 ELSE 2.0 END + CASE WHEN l.page = t.page THEN 0.5 ELSE 0 END AS score FROM l JOIN t ON l.doc_id = t.doc_id AND abs(l.page - t.page) <= 1 AND (contains(lt, target) OR contains(target, lt))),
e AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, ord ORDER BY score DESC, idx) = 1)
SELECT doc_id, idx, title, score::DOUBLE AS score FROM e QUALIFY row_number() OVER (PARTITION BY doc_id, idx ORDER BY score DESC, ord) = 1"""



def terms_sql(c: str) -> str:
    """Every term replaced, longest first, in any case."""
    for en, zh in sorted(P.TERMS.items(), key=lambda kv: -len(kv[0])):
        c = f"regexp_replace({c}, '{en}', '{zh}', 'gi')"
    return f"trim({c})"


def entity_sql(c: str) -> str:
    """Terms replaced, articles and of dropped."""
    return f"array_to_string(list_filter(string_split({terms_sql(c)}, ' '), lambda w: w NOT IN ('', 'the', 'a', 'an', 'of')), ' ')"


def _zh_forms() -> str:
    """The forms of the written papers' statements over `t`, in order."""

    def part(pattern: str, n: int) -> str:
        return f"regexp_extract(t, '{pattern}', {n})"

    def spaced(c: str) -> str:
        return f"CASE WHEN regexp_matches({c}, '[A-Za-z0-9]$') THEN {c} || ' ' ELSE {c} END"

    out = []
    for pattern, before, after in (
        (r"^(.+?) significantly (increases|decreases) (.+?)\.?$", "可显著", None), (r"^(.+?) does not significantly (increase|decrease) (.+?)\.?$", "不会显著", None), (r"^(.+?) (increases|decreases) (.+?)\.?$", "可", None),
        (r"^(.+?) does not (increase|decrease) (.+?)\.?$", "不会", None), (r"^(.+?) is associated with (increased|decreased) (.+?)\.?$", "与 ", "相关。"), (r"^(.+?) is not associated with (increased|decreased) (.+?)\.?$", "与 ", "不相关。"),
    ):
        verb = f"CASE WHEN starts_with({part(pattern, 2)}, 'increase') THEN '提高' ELSE '降低' END"
        s, o = entity_sql(part(pattern, 1)), entity_sql(part(pattern, 3))
        tail = f"{verb} || ' ' || {o} || '。'" if after is None else f"{o} || ' 的' || {verb} || '{after}'"
        out.append(f"WHEN regexp_matches(t, '{pattern}') THEN {spaced(s)} || '{before}' || {tail}")
    causes = r"^(.+?) causes (.+?)\.?$"
    out.append(f"WHEN regexp_matches(t, '{causes}') THEN {spaced(entity_sql(part(causes, 1)))} || '导致 ' || {entity_sql(part(causes, 2))} || '。'")
    would = r"^(.+?) would (increase|decrease), as already observed in the (.+?) group\.?$"
    out.append(f"WHEN regexp_matches(t, '{would}') THEN {spaced(entity_sql(part(would, 1)))} || '将会' || CASE {part(would, 2)} WHEN 'increase' THEN '提高' ELSE '降低' END || '，这在' || {entity_sql(part(would, 3))} || '组中已被观察到。'")
    base = r"^The (.+?) group provides the baseline level of (.+?) against which (.+?) is compared\.?$"
    out.append(f"WHEN regexp_matches(t, '{base}') THEN {entity_sql(part(base, 1))} || '组提供' || {entity_sql(part(base, 2))} || '的基线水平，用于与' || {entity_sql(part(base, 3))} || ' 进行比较。'")
    return "CASE " + " ".join(out) + " END"


TRANSLATED_SETS = f"""WITH {DRAFTS}, st AS (SELECT doc_id, set_id || '_' || lpad(nn::VARCHAR, 2, '0') AS draft_id, statement, abbr, starts_with(statement, 'According to ') AS anchored, regexp_extract(statement, '^According to (.+?), ', 1) AS label,
  CASE WHEN starts_with(statement, 'According to ') THEN regexp_extract(statement, '^According to .+?, (.+)$', 1) ELSE statement END AS t FROM dr),
zh AS (SELECT *, {_zh_forms()} AS formed FROM st)
SELECT doc_id, draft_id, CASE WHEN anchored AND abbr = 'ds' THEN '根据' || label || '，论文原文报告：' || {terms_sql(r"regexp_replace(t, '\.+$', '')")} || '。' WHEN anchored THEN '根据' || label || '，' || coalesce(formed, {entity_sql('t')}) ELSE coalesce(formed, {entity_sql('t')}) END AS statement_zh,
  CASE WHEN anchored OR formed IS NOT NULL THEN 'template' ELSE 'term_fallback' END AS method FROM zh"""

#: Paragraphs are packed while they fit; one over 1200 characters is cut into its sentences, and those again. A piece of such a paragraph starts with the last sentence of the piece before it.
CHUNKS = r"""WITH RECURSIVE l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS idx, trim(unnest(string_split(text, chr(10)))) AS x FROM documents),
s AS (SELECT doc_id, idx, generate_subscripts(ss, 1) AS j, unnest(ss) AS x FROM (SELECT doc_id, idx, list_filter(list_transform(string_split(regexp_replace(x, '([。！？；!?;])', '\1' || chr(1), 'g'), chr(1)), lambda y: trim(y)), lambda y: y <> '') AS ss FROM l WHERE length(x) > 1200)),
i AS (SELECT doc_id, idx, 0 AS j, 0 AS part, 'P' AS kind, x FROM l WHERE x <> '' AND length(x) <= 1200 UNION ALL SELECT doc_id, idx, j, 0, 'S', x FROM s WHERE length(x) <= 1200
  UNION ALL SELECT doc_id, idx, j, part, 'H', substr(x, (1200 * part + 1)::BIGINT, 1200) FROM (SELECT *, unnest(range(0, ceil(length(x) / 1200.0)::BIGINT)) AS part FROM s WHERE length(x) > 1200)),
p AS (SELECT *, length(x) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY idx, j, part) AS k FROM i),
w AS (SELECT doc_id, k, idx, kind, n, 1::BIGINT AS piece, n AS cur FROM p WHERE k = 1
  UNION ALL SELECT p.doc_id, p.k, p.idx, p.kind, p.n, w.piece + CASE WHEN t THEN 0 ELSE 1 END, p.n + CASE WHEN t THEN w.cur ELSE 0 END
  FROM (SELECT w.*, p.k AS k2, w.cur + p.n <= 600 AND p.kind = w.kind AND p.kind <> 'H' AND (p.kind = 'P' OR p.idx = w.idx) AS t FROM w JOIN p ON p.doc_id = w.doc_id AND p.k = w.k + 1) w JOIN p ON p.doc_id = w.doc_id AND p.k = w.k2),
g AS (SELECT w.doc_id, piece, any_value(w.kind) AS kind, min(w.idx) AS idx, sum(w.n) AS n, count(DISTINCT w.idx) AS paras, length(trim(max_by(p.x, p.k))) AS last FROM w JOIN p USING (doc_id, k) GROUP BY ALL),
o AS (SELECT *, CASE WHEN kind <> 'P' AND lag(idx) OVER d = idx AND n + lag(last) OVER d <= 1200 THEN n + lag(last) OVER d ELSE n END AS size FROM g WINDOW d AS (PARTITION BY doc_id ORDER BY piece)),
c AS (SELECT doc_id::VARCHAR AS doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY piece) AS seq, size, paras FROM o)"""
GREEDY_CHUNKS = f"{CHUNKS} SELECT doc_id, seq::INT AS seq, left(sha1(doc_id || '|正文|' || seq), 16) AS chunk_id, size::INT AS char_count, paras::INT AS n_paragraphs FROM c"
CHUNK_STATS = f"{CHUNKS} SELECT doc_id, count(*) AS n_chunks, min(size)::INT AS min_chars, max(size)::INT AS max_chars, round(avg(size), 1) AS avg_chars FROM c GROUP BY doc_id"
