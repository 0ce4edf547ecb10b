"""Labelled exemplars of template residue, and of talk about it. Fixed values.

Some follow messages of the test tables, the others are the usual wordings of servers, programs,
databases and templates. An ASCII word with a digit stands for any such word.
"""

# error messages of pages and programs
ERRORS = """
400 Bad Request
401 Unauthorized
403 Forbidden
404 Not Found
408 Request Timeout
410 Gone
429 Too Many Requests
500 Internal Server Error
502 Bad Gateway
503 Service Unavailable
504 Gateway Timeout
Gateway time-out
Error 404: Not Found Reference ID: 0
Error 403: Forbidden Reference ID: 0
Error 401: Unauthorized Reference ID: 0
Error 410: Gone Reference ID: 0
Error 500: Internal Server Error Reference ID: 0
Error 502: Bad Gateway Reference ID: 0
Error 503: Service Unavailable Reference ID: 0
Error 504: Gateway Timeout Reference ID: 0
Reference ID: 0
Error 500
Fehler 404
Erreur 404
The page you asked for could not be found on this server.
The requested page could not be found.
La page demandée est introuvable.
No se ha encontrado la página solicitada.
Die angeforderte Seite wurde nicht gefunden.
The server met an internal problem and was unable to complete your request. Please contact the administrator and give the time of the error.
Please contact the administrator and give the time of the error.
Service temporarily unavailable
Service temporarily unavailable We are carrying out maintenance. Back soon.
We are carrying out maintenance. Back soon.
El servicio no está disponible en este momento. Inténtelo más tarde.
Service momentanément indisponible, veuillez réessayer plus tard.
Der Dienst ist vorübergehend nicht verfügbar. Bitte versuchen Sie es später erneut.
Access denied You do not have permission to view this resource. Request
You do not have permission to view this resource.
Your session has expired. Please log in again to continue.
Sorry, something went wrong on our side. Try again in a few minutes. Incident 0
This site can't be reached The connection was reset.
Gateway time-out The upstream host did not answer in time. nimbled/2.52 at edge-2377
Too many requests. Slow down and retry after 37 seconds.
Page not available It may have been moved or deleted. < Back to start page
Sorry, an error occurred. Please try again later.
The upstream server took too long to answer. Try again in a few minutes.
Template could not be rendered. digest html
Fatal error: Uncaught exception RuntimeFault RuntimeException: cannot open store in /srv/app/render.ph php on line 1
Stack trace: #0 /srv/app/mail.ph(27): render() #1 {main} thrown
#0 {main}
Traceback (most recent call last): File "/opt/bulletin/send.py", line 1, in render KeyError: 'body'
Traceback (most recent call last):
File "/opt/bulletin/send.py", line 1, in render
KeyError: 'body'
{"status": 500, "error": "Internal Server Error", "trace": "0"}
{"status": 404, "error": "Not Found", "trace": "0"}
{"status": 403, "error": "Forbidden", "trace": "0"}
{"status": 401, "error": "Unauthorized", "trace": "0"}
{"status": 410, "error": "Gone", "trace": "0"}
{"status": 502, "error": "Bad Gateway", "trace": "0"}
{"status": 503, "error": "Service Unavailable", "trace": "0"}
{"status": 504, "error": "Gateway Timeout", "trace": "0"}
< Back to start page
Back to start page
100 Continue
402 Payment Required
405 Method Not Allowed
406 Not Acceptable
409 Conflict
411 Length Required
413 Payload Too Large Request Entity Too Large
414 URI Too Long
415 Unsupported Media Type
418 I'm a teapot
422 Unprocessable Entity
423 Locked
431 Request Header Fields Too Large
451 Unavailable For Legal Reasons
501 Not Implemented
505 HTTP Version Not Supported
507 Insufficient Storage
520 Web server returned an unknown error
521 Web server is down
522 Connection timed out
524 A timeout occurred
Access denied. Access to this page has been denied. You are not authorized to access this page. Permission denied. Access forbidden.
Zugriff verweigert. Sie haben keine Berechtigung, auf diese Seite zuzugreifen. Zugriff nicht gestattet. Nicht autorisiert.
Accès refusé. Accès interdit. Vous n'êtes pas autorisé à accéder à cette page. Vous n'avez pas les droits nécessaires.
Acceso denegado. Acceso prohibido. No tiene permiso para acceder a esta página. No está autorizado.
Accesso negato. Non sei autorizzato ad accedere a questa pagina. Pagina non trovata.
Acesso negado. Você não tem permissão para acessar esta página. Página não encontrada.
Toegang geweigerd. U heeft geen toestemming om deze pagina te bekijken. Pagina niet gevonden.
Seite nicht gefunden. Diese Seite existiert nicht oder wurde verschoben. Die Seite konnte nicht gefunden werden. Datei nicht gefunden.
Page introuvable. La page que vous recherchez n'existe pas ou a été déplacée. Fichier introuvable.
Página no encontrada. La página que busca no existe o ha sido movida. Archivo no encontrado.
Page not found. The page you are looking for does not exist, has been removed, had its name changed or is temporarily unavailable.
The requested URL was not found on this server. File not found. Resource not found. No such file or directory.
Ein interner Fehler ist aufgetreten. Es ist ein Fehler aufgetreten. Ein unerwarteter Fehler ist aufgetreten. Interner Serverfehler. Bitte versuchen Sie es später noch einmal.
Une erreur est survenue. Une erreur interne s'est produite. Erreur interne du serveur. Veuillez réessayer plus tard.
Se ha producido un error. Ha ocurrido un error inesperado. Error interno del servidor. Por favor, inténtelo de nuevo más tarde.
An error occurred while processing your request. An unexpected error has occurred. Something went wrong. Oops! Please try again later.
The server encountered an internal error or misconfiguration and was unable to complete your request.
The server is temporarily unable to service your request due to maintenance downtime or capacity problems. Please try again later.
The service is unavailable. The site is down for maintenance. Scheduled maintenance in progress. We'll be back shortly.
Wartungsarbeiten. Wegen Wartungsarbeiten ist diese Seite derzeit nicht erreichbar. Der Server ist überlastet.
Site en maintenance. Le serveur est indisponible. Le serveur est surchargé.
Sitio en mantenimiento. El servidor no responde. Servidor sobrecargado.
Your session has timed out. Session expired. Please sign in again. Your login has expired.
Ihre Sitzung ist abgelaufen. Bitte melden Sie sich erneut an.
Votre session a expiré. Veuillez vous reconnecter.
Su sesión ha caducado. Por favor, inicie sesión de nuevo.
Too many requests. You have exceeded the rate limit. Please slow down. Rate limit exceeded. Quota exceeded.
Zu viele Anfragen. Bitte warten Sie einen Moment.
Trop de requêtes. Veuillez patienter.
Demasiadas solicitudes. Espere un momento.
Database connection failed: too many clients. Too many connections. Error establishing a database connection. Could not connect to the database server.
Datenbankverbindung fehlgeschlagen. Keine Verbindung zur Datenbank. Verbindung zum Server fehlgeschlagen.
Échec de la connexion à la base de données. Impossible de se connecter au serveur.
Error de conexión a la base de datos. No se pudo conectar con el servidor.
You have an error in your SQL syntax; check the manual for the right syntax to use near line 0
Connection refused. Connection timed out. Connection reset by peer. Host unreachable. Name resolution failed. DNS error. SSL handshake failed.
The request timed out. The operation timed out. Request timeout. Upstream connect error or disconnect before headers.
Verbindung abgelehnt. Zeitüberschreitung der Anfrage. Die Verbindung wurde zurückgesetzt.
Délai d'attente dépassé. La connexion a été réinitialisée.
Tiempo de espera agotado. Se ha restablecido la conexión.
Out of memory. Allowed memory size exhausted. Segmentation fault. Core dumped. Disk full. No space left on device.
Exception in thread "main" java.lang.NullPointerException at java.lang.IllegalStateException Caused by: at
Unhandled exception. Uncaught TypeError: undefined is not a function. Cannot read properties of undefined. ReferenceError: is not defined
Warning: Undefined variable in on line 0. Notice: Undefined index. Fatal error: Call to undefined function. Parse error: syntax error, unexpected
ValueError TypeError AttributeError NameError IndexError ImportError RuntimeError: in line 0 module
Template error: variable is undefined. Template not found. Missing template variable. Rendering failed. Could not render template.
Invalid request. Bad request. Invalid token. CSRF verification failed. Request aborted. Missing parameter.
Please complete the security check to access. Verify you are human. Captcha required. Your IP address has been blocked.
Content could not be loaded. The content is not available. This content is no longer available. Unable to load the message. Message could not be displayed.
Der Inhalt konnte nicht geladen werden. Die Nachricht kann nicht angezeigt werden.
Le contenu n'a pas pu être chargé. Le message ne peut pas être affiché.
No se pudo cargar el contenido. El mensaje no se puede mostrar.
Error: Error 0 Fehler: Erreur: Error code Status: Failed. Failure. Aborted.
{"code": 0, "message": "Internal error", "status": "error", "success": false, "details": null, "path": "0", "timestamp": "0"}
"""

# words by which any error message may give its number
NUMBERS = """
code error id request ray trace correlation incident ticket case number reference support 0
fehler fehlercode vorgangsnummer vorgang anfrage vorfallnummer referenznummer fallnummer
erreur numéro incident référence identifiant requête dossier
código error número incidencia referencia identificador solicitud caso
"""

# notices that scripts are required
SCRIPTS = """
Please enable JavaScript to view this message.
You need to turn on JavaScript to run this app. You need to enable JavaScript to run this app.
We're sorry but the reader doesn't work properly without JavaScript enabled. Please enable it to continue.
JavaScript is disabled in your browser, so the content cannot be shown.
This page requires JavaScript. Your browser does not support it or has it switched off.
For full functionality of this mail it is necessary to activate scripts. For full functionality of this site it is necessary to enable JavaScript.
Checking your browser... Turn on JS to continue.
This viewer needs scripting and cookies. Change your settings and try again.
Scripts are blocked. Allow scripts and reload to see the newsletter.
Bitte aktivieren Sie JavaScript, um diese Nachricht anzuzeigen.
Für diese Ansicht werden Skripte benötigt. Ihr Browser hat sie abgeschaltet.
Veuillez activer JavaScript pour afficher ce message.
Les scripts sont désactivés dans votre navigateur ; le contenu ne peut être affiché.
Active JavaScript para ver este mensaje.
Su navegador tiene los scripts desactivados y no se puede mostrar el contenido.
JavaScript is required. Please enable JavaScript in your browser settings and reload the page to continue.
This site requires JavaScript and cookies to be enabled. JavaScript must be enabled in order for you to use this page.
Your browser does not support JavaScript or it is turned off. Please turn on scripting and refresh.
Enable scripts to view this content. Scripts are disabled. Active scripting is required. Please allow scripts in this mail.
You are using an outdated browser. Please upgrade your browser or activate script support.
JavaScript ist deaktiviert. Bitte schalten Sie JavaScript in Ihrem Browser ein und laden Sie die Seite neu. Diese Seite benötigt JavaScript. Skripte müssen erlaubt sein.
JavaScript est désactivé. Cette page nécessite JavaScript. Veuillez autoriser les scripts et recharger la page. Votre navigateur ne prend pas en charge les scripts.
JavaScript está desactivado. Esta página requiere JavaScript. Habilite los scripts en su navegador y vuelva a cargar la página.
JavaScript è disattivato. Abilita JavaScript nel browser per visualizzare questa pagina.
O JavaScript está desativado. Ative o JavaScript no navegador para ver esta página.
Schakel JavaScript in om deze pagina te bekijken.
"""

# filler; a window of words from one line counts, in any order
FILLER = """
lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua
lorem ipsum dolor sit amet vel offici anima sunt culpam magnus cilla velit incunda nostrum fugam aliqua labrem estor pariat tempor moltis quaevis
blah blah blah blah
asdf asdf qwer asdf asdfgh qwerty
xxxxx xxxx xxxxxxx xx xxx xxxxxx
Test test test 123
Sample text sample text sample text.
Body copy goes here.
Text goes here. Your text here.
[content pending]
Content coming soon.
TODO write the announcement
TBD to be done
Caption for picture 1
This is a dummy paragraph used to check the layout.
Headline One
Second headline, max. 60 characters
Headline, max. 60 characters
Replace this paragraph with your own words.
Blindtext Blindtext Blindtext, hier steht später der Inhalt.
Beispieltext, vor dem Versand ersetzen.
Texte provisoire, à remplacer avant l'envoi.
Texto de ejemplo, sustituir antes de enviar.
lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum
This is placeholder text. Placeholder. Dummy text. Sample text. Example text. Insert text here. Insert your text here. Type your text here. Add text here. Write something here. Enter text here.
Text to follow. Copy to follow. To be announced. To be confirmed. To be completed. To be defined. Coming soon. Under construction. Draft text, do not send.
Platzhaltertext. Mustertext. Blindtext. Beispieltext. Hier steht Ihr Text. Hier Text einfügen. Text folgt. Inhalt folgt in Kürze. Wird noch ergänzt.
Texte d'exemple. Faux texte. Insérez votre texte ici. Texte à venir. Contenu à venir. À compléter.
Texto de relleno. Texto de prueba. Inserte su texto aquí. Texto por venir. Contenido próximamente. Por completar.
Testo di prova. Inserire qui il testo. Texto de exemplo. Insira o texto aqui. Voorbeeldtekst. Tekst volgt.
TODO FIXME TBD TBA XXX placeholder lorem foo bar baz foobar qux
test test testing test message this is a test please ignore test mail testmail 0
the quick brown fox jumps over the lazy dog
Click to edit. Click here to add text. Double click to edit. Edit me. Your headline here. Heading. Subheading. Subtitle goes here. Title goes here. Image caption. Picture 0 here. Button text.
"""

# messages with content of their own that mention, quote or explain such strings
TALK = """
The last mailing went out with slot in the greeting, which is embarrassing; has fixed the merge and people get an apology.
In der letzten Rundmail stand slot statt des Namens, hat das inzwischen behoben.
Dans la dernière lettre il y avait slot à la place du nom, l'a corrigé.
En la última carta aparecía slot en lugar del nombre, ya lo arregló.
In the editor you type slot and the program puts the person's name there, so please keep the spelling exactly as it is.
Reminder for whoever edits the letter: slot stands for the addressee and must not be translated.
I propose the wording Dear slot for the paper letters and would like your opinion on the too.
Set retries = slot in the config, where max is 3 for us; the comment above the line explains the braces.
My script does echo slot and then printf '%s %s' "$1" "$2", it prints both lines correctly.
Leave the blank lines slot on the paper form, people fill them in with a pen.
$HOME/bin:slot:~user C:\\Temp\\new%20file.txt
if (x<0){return a[i]+b[j];} // {not a field}
The placeholder slot is replaced by the variable name in the template.
Customers report that the letter says slot where their name should be; we are looking into it and will send a correction.
Why does the mail show slot instead of my name? Please fix the template.
Mehrere Kunden haben uns gemeldet, dass in der Mail slot statt ihres Namens stand; wir korrigieren die Vorlage.
Plusieurs clients ont signalé que le message affichait slot au lieu de leur nom ; nous corrigeons le modèle.
Varios clientes han avisado de que el mensaje mostraba slot en lugar de su nombre; vamos a corregir la plantilla.
The template uses slot for the name, and the variable slot is filled in by the script when the letter is printed.
In the documentation, write slot where the value goes; the syntax with braces means a variable.
"""

# placeholders: kinds of delimiters, and the slot between them: * for any name, else the words of names of fields
PLACEHOLDERS = """
{{ : *
{{{ : *
{% : *
<% : *
${ : *
#{ : *
{! : *
*| : *
@@ : *
## : *
%% : *
%(s : *
[[ : *
<< : *
(goes-here : *
[insert : *
__ : *
xxxxx : *
____ : *
{0 : *
{ [ < % $ « : your the address agent amount balance bill billing brand city code company contact country coupon currency customer client date day due email event field first firstname fname full fullname given greeting here id insert invoice item job key last lastname link lname location login mail member middle mobile month name nr no number order ordernumber organisation organization parcel password period person phone position price product quantity recipient ref reference role salutation sender sendername sendings ship shipdate shipping shop sign signature staff state store street subject sum surname team telephone text time title total tracking trackingurl unsubscribe url user username value variable venue website year zip
{ [ < % $ « : der die das dein deine ihr ihre adresse anrede ansprechpartner bestellnr bestelldatum bestellnummer betrag betreff bezeichnung datum email empfänger firma frist geburtsdatum hier kunde kunden kundenname kundennr kundennummer land link mitarbeiter nachname name nr nummer ort plz preis produkt rechnung rechnungsnr rechnungsnummer straße strasse tag team telefon termin text titel unterschrift uhrzeit vorname wert zeit
{ [ < % $ « : le la les votre vos adresse client code commande courriel date destinataire entreprise équipe expéditeur facture heure ici ville insérer jour lien lieu montant nom numéro objet pays prénom prenom prix produit référence salutation société téléphone texte titre total valeur
{ [ < % $ « : el los su sus apellido apellidos asunto aquí cantidad ciudad cliente código correo dirección destinatario empresa enlace equipo factura fecha firma hora importe insertar lugar nombre número país pedido precio producto referencia remitente saludo teléfono texto título total valor
"""


def lines(text: str) -> list[str]:
    return [x for x in text.strip().split("\n") if x]
