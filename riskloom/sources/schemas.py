"""Explicit schemas of all sources; nothing is inferred."""

FINDING = "cve STRING, cve_id STRING, package STRING, installed_version STRING, fixed_version STRING, severity STRING, cvss_vector STRING, cvss_score DOUBLE, parsed_cvss STRUCT<attack_vector:STRING, privileges_required:STRING, user_interaction:BOOLEAN, impact:STRUCT<confidentiality:STRING, integrity:STRING, availability:STRING>>, cwe ARRAY<STRING>, commit_urls ARRAY<STRING>, primary_url STRING"
RAW_SCAN = "Results ARRAY<STRUCT<Vulnerabilities:ARRAY<STRUCT<VulnerabilityID:STRING, PkgName:STRING, InstalledVersion:STRING, FixedVersion:STRING, Severity:STRING, CVSS:STRUCT<nvd:STRUCT<V3Vector:STRING, V3Score:DOUBLE>, ghsa:STRUCT<V3Vector:STRING, V3Score:DOUBLE>>, CweIDs:ARRAY<STRING>, References:ARRAY<STRING>, PrimaryURL:STRING>>>>"
EPSS = "MAP<STRING, STRUCT<epss:DOUBLE, percentile:DOUBLE>>"
KEV = "catalog ARRAY<STRING>, snapshot_date STRING"
SYMBOL = "STRUCT<fully_qualified_name:STRING, short_name:STRING, kind:STRING, file_in_patch:STRING, change_classification:STRING, before_signature:STRING, after_signature:STRING, lines_added:INT, lines_removed:INT, summary:STRING>"
PATCH = f"cve_id STRING, package STRING, fetched_at STRING, status STRING, sources_tried ARRAY<STRING>, patch_url STRING, patch_commit STRING, patch_repo STRING, files_changed ARRAY<STRING>, vulnerable_symbols ARRAY<{SYMBOL}>, import_aliases ARRAY<STRING>"
DEPENDENCY_GRAPH = "nodes ARRAY<STRUCT<relation:STRING, versionKey:STRUCT<system:STRING, name:STRING, version:STRING>>>, edges ARRAY<STRUCT<fromNode:INT, toNode:INT, requirement:STRING>>, error STRING, _python_requires STRING"
ADVISORY = "vulns ARRAY<STRUCT<id:STRING, aliases:ARRAY<STRING>, summary:STRING, details:STRING, severity:ARRAY<STRUCT<type:STRING, score:STRING>>>>"
CORPUS = "version STRING, cases ARRAY<STRUCT<cve_id:STRING, package:STRING, installed_version:STRING, cvss:DOUBLE, epss:DOUBLE, in_kev:BOOLEAN, reachable:BOOLEAN, must_fix:BOOLEAN, source:STRING>>"
AUDIT = "timestamp STRING, tenant STRING, actor STRING, action STRING, details MAP<STRING,STRING>, prev_hash STRING, entry_hash STRING"
SNAPSHOT = "nodes STRUCT<packages:ARRAY<STRUCT<id:STRING,name:STRING,installed_version:STRING>>, cves:ARRAY<STRUCT<id:STRING,cve_id:STRING,cvss_score:DOUBLE,severity:STRING,cwe_ids:ARRAY<STRING>>>, functions:ARRAY<STRUCT<id:STRING,qualified_name:STRING,file:STRING,line_start:INT,line_end:INT>>, services:ARRAY<STRUCT<id:STRING,name:STRING,route:STRING,method:STRING,handler:STRING,file:STRING>>>, edges MAP<STRING, ARRAY<STRUCT<`from`:STRING, `to`:STRING>>>"
FLYWHEEL = "total_scans LONG, reachability STRUCT<reachable:LONG, unreachable:LONG, rate:DOUBLE>, recommendations MAP<STRING,LONG>, packages_seen MAP<STRING,LONG>"
