"""The driver tables seen as papers, chunks, compounds, requests and runs; the text is valid in both SQL dialects."""

PAPERS = """
SELECT p_partkey AS id,
  CASE CAST(p_partkey % 6 AS INT) WHEN 0 THEN '/mnt/disk/old_sweet/' || replace(p_name, ' ', '_') || '.pdf'
    WHEN 1 THEN 'library' || chr(92) || 'dual' || chr(92) || replace(p_name, ' ', '_') || '.pdf'
    WHEN 2 THEN '/srv/app/data//notes/' || replace(p_name, ' ', '_') || '.md'
    WHEN 3 THEN 'old_dual/' || replace(p_name, ' ', '_') || '.pdf'
    WHEN 4 THEN '/elsewhere/' || p_brand || '.v1.txt' ELSE '' END AS file_path,
  CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN p_brand || ' et al - ' || CAST(1980 + p_partkey % 45 AS STRING) || ' - ' || p_name || '.pdf'
    WHEN 1 THEN 'dataset ' || p_name || ' (2).pdf' ELSE p_name || ' copy.docx' END AS filename,
  CASE WHEN p_partkey % 7 = 0 THEN 'N/A' WHEN p_partkey % 11 = 0 THEN ' ' ELSE p_name || ':  a <b>' || lower(p_type) || '</b> review.' END AS title,
  CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN 'Ada Lovelace; Bo; Carl Sagan ; Dee Dee; Eva Green' WHEN 1 THEN 'Ann Lee, Bob Ray' WHEN 2 THEN 'Jo March and Amy March'
    WHEN 3 THEN p_brand ELSE 'Unknown' END AS authors,
  CASE CAST(p_partkey % 8 AS INT) WHEN 0 THEN 'Food Chemistry' WHEN 1 THEN 'Nature Food' WHEN 2 THEN 'Unknown Journal' WHEN 3 THEN 'Meat Science' WHEN 4 THEN 'Clinical Trials, '
    WHEN 5 THEN '' WHEN 6 THEN 'Annals of ' || lower(p_type) ELSE NULL END AS journal,
  CASE WHEN p_partkey % 9 = 0 THEN 'N/A' WHEN p_partkey % 9 = 1 THEN NULL ELSE CAST(1990 + p_partkey % 36 AS STRING) || '-05' END AS year,
  CASE WHEN p_partkey % 4 = 0 THEN '' ELSE CAST(p_size AS STRING) END AS volume,
  CASE WHEN p_partkey % 3 = 0 THEN 'n/a' ELSE CAST(p_partkey % 12 + 1 AS STRING) END AS issue,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_size AS STRING) || '-' || CAST(p_size + 9 AS STRING) END AS pages,
  CASE CAST(p_partkey % 6 AS INT) WHEN 0 THEN 'https://doi.org/10.1016/j.food.' || CAST(p_partkey AS STRING) || '.' WHEN 1 THEN 'doi: 10.1093/abc/def/' || CAST(p_partkey AS STRING)
    WHEN 2 THEN 'Not Available' WHEN 3 THEN '10.1000/x(' || CAST(p_partkey AS STRING) || ')' WHEN 4 THEN '10.1371/s-' || CAST(p_partkey AS STRING) || '/-/DCSupplemental' ELSE NULL END AS doi,
  CASE WHEN p_partkey % 2 = 0 THEN CAST(30000000 + p_partkey AS STRING) ELSE 'none' END AS pubmed
FROM {part}
"""

COMPOUNDS = """
SELECT p_partkey AS cid, p_name AS name, CASE WHEN p_partkey % 10 = 3 THEN ' placeholder ' WHEN p_partkey % 10 = 4 THEN 'N/A' WHEN p_partkey % 10 = 5 THEN '  ' ELSE ' ' || p_brand || ' ' END AS formula,
  CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 7 = 1 THEN 'abc' ELSE CAST(p_retailprice AS STRING) END AS mw_text,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice / 3 END AS mw, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_size / 5.0 - 4 END AS logp,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size * 37.0 % 1400 / 1.3 END AS sweetness, CAST(p_size % 9 AS INT) AS donors, CAST(p_size % 14 AS INT) AS acceptors,
  p_size * 3.0 AS tpsa, p_brand AS brand, p_type AS kind
FROM {part}
"""

REQUESTS = """
SELECT o_orderkey AS id, CASE CAST(o_orderkey % 8 AS INT)
    WHEN 0 THEN 'Run ' || CAST(o_orderkey % 90 AS STRING) || '.5 ns at 310 K and 1.01 bar with 0.15 M NaCl'
    WHEN 1 THEN 'Why did the ligand escape? It crashed after heating 20 ps' WHEN 2 THEN 'set up a box, padding of 12 A, cutoff 9 angstrom, timestep 2 fs'
    WHEN 3 THEN 'What is the difference between 300 K and 310 K?' WHEN 4 THEN 'write trajectory every 10 ps, equilibrate for 500 ps'
    WHEN 5 THEN CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN '如何设置 模拟' WHEN 1 THEN 'net charge: -1, keep charges, ff14SB with TIP3P and the compatibility preset' ELSE 'multiplicity 2 by AM1-BCC, ff19sb, OPC water, standard preset' END
    WHEN 6 THEN 'predict CC(=O)O, CCO. and C1=CC=C(C=C1)O by TPSA and ECFP, c1ccccc1 [Na+] for the sweet taste of CCO' ELSE o_orderpriority END AS text
FROM {orders}
"""

ANSWERS = """
SELECT o_orderkey AS id, CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN 'Sugar is sweet [ref_1, ref_99] and so is  honey [ref_2].'
    WHEN 1 THEN 'I cannot answer that.' WHEN 2 THEN 'See [ref_77] only.' WHEN 3 THEN '证据不足' WHEN 4 THEN 'Twice [ref_2] and again [ref_2,ref_1] with [3] and [CrossRef]' ELSE 'Nothing cited' END AS answer,
  CAST(o_orderkey % 6 AS INT) AS kind, o_totalprice AS price
FROM {orders}
"""
