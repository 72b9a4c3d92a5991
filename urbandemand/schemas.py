"""Schemas of the inputs."""

from __future__ import annotations

POINT = "struct<lat:double,lon:double>"
BOUNDS = "struct<minlat:double,minlon:double,maxlat:double,maxlon:double>"
OSM_ELEMENT = f"type string, id bigint, lat double, lon double, bounds {BOUNDS}, nodes array<bigint>, geometry array<{POINT}>, tags map<string,string>"
VIEW_STATE = "struct<zoom:double,latitude:double,longitude:double,bearing:double>"
PLACE = f"code string, name string, description string, bbox array<double>, population bigint, initialViewState {VIEW_STATE}, thumbnailBbox array<double>"
CONFIG = f"`tile-zoom-level` int, locale string, places array<struct<code:string,name:string,description:string,bbox:array<double>,population:bigint,initialViewState:{VIEW_STATE},thumbnailBbox:array<double>>>"
FEATURES = "type string, features array<struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
ROUTE = "routes array<struct<distance:double,duration:double,legs:array<struct<steps:array<struct<geometry:struct<coordinates:array<array<double>>>>>>>>>"
