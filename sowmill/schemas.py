"""Schemas of the tables that are read from files."""

from __future__ import annotations

SOW_RECORD = (
    "file_name string, extraction_timestamp string, client_name string, project_title string, start_date string, "
    "end_date string, project_length string, scope_summary string, deliverables array<string>, "
    "exclusions array<string>, staffing_plan array<struct<name:string,role:string,allocation:string>>, "
    "staffing_plan_structured array<struct<name:string,level:string,title:string,primary_role:string,"
    "hours:double,hours_pct:double>>"
)
STAFFING_ENTRY = (
    "file string, name string, role string, primary_role string, level string, workstream string, location string, "
    "percentage double, hours double, page int, source_table_index int, row_index int, "
    "column_values map<string,string>"
)
MINIMAL_FILE = (
    "file string, entries array<struct<name:string,level:string,title:string,primary_role:string,"
    "hours:double,hours_pct:double>>"
)
