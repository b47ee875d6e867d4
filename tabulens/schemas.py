"""Schemas of the raw tables that sources deliver."""

from __future__ import annotations

ANNOTATIONS = "array<struct<name:string,value:string>>"
COLUMN = (
    "struct<ord:int,name:string,dataType:string,isHidden:boolean,isKey:boolean,type:string,expression:string,formatString:string,"
    f"description:string,sourceColumn:string,dataCategory:string,summarizeBy:string,hasDateVariation:boolean,defaultHierarchy:string,annotations:{ANNOTATIONS}>"
)
MEASURE = "struct<ord:int,name:string,expression:string,formatString:string,description:string,isHidden:boolean,lineageTag:string>"
PARTITION = "struct<ord:int,name:string,mode:string,type:string,expression:string>"

RAW_TABLE = (
    "project_id string, ord int, name string, isHidden boolean, description string, dataCategory string, markAsDateTable boolean, "
    f"annotations {ANNOTATIONS}, columns array<{COLUMN}>, measures array<{MEASURE}>, partitions array<{PARTITION}>"
)
RAW_RELATIONSHIP = (
    "project_id string, ord int, id string, fromTable string, fromColumn string, toTable string, toColumn string, cardinality string, "
    "fromCardinality string, toCardinality string, crossFilteringBehavior string, isActive string"
)
RAW_EXPRESSION = "project_id string, ord int, name string, expression string, kind string"
RAW_MODEL = "project_id string, name string, culture string, compatibilityLevel string, sourceQueryCulture string, defaultPowerBIDataSourceVersion string"
RAW_PAGE = "project_id string, ord int, page_id string, page_name string, raw string"
RAW_VISUAL = (
    "project_id string, page_id string, page_name string, ord int, visual_id string, visual_name string, raw_type string, raw string"
)
PROJECT = "project_id string, project_name string, model_name string, model_format string, report_format string, error string"
